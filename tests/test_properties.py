"""Property tests: map text codec, hash folds, split completeness."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from featloom.functions.hashing import (java_hash_bucket, java_hash_bucket_col, sha1_bucket,
                                        sha1_bucket_col)
from featloom.functions.mapstr import pack_map, unpack_map

KEYS = st.text(alphabet="abcdefghij0123456789_", min_size=1, max_size=6)
MAPS = st.dictionaries(KEYS, st.integers(min_value=0, max_value=10 ** 6), max_size=8)
TEXT = st.text(alphabet=st.characters(min_codepoint=32, max_codepoint=0x2FF), max_size=12)
SETTINGS = settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@SETTINGS
@given(MAPS)
def test_pack_unpack_identity_on_sorted_input(spark, m):
    text = ";".join(f"{k}:{float(v)}" for k, v in sorted(m.items()))
    got = spark.range(1).select(pack_map(unpack_map(F.lit(text))).alias("r")).first().r
    assert got == text


@SETTINGS
@given(st.lists(TEXT, min_size=1, max_size=8))
def test_hash_columns_match_driver(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select(java_hash_bucket_col("v", prefix="slot"), sha1_bucket_col("v", prefix="s\t")).collect()
    assert [r[0] for r in rows] == [java_hash_bucket("slot" + v) for v in values]
    assert [r[1] for r in rows] == [sha1_bucket("s\t" + v) for v in values]

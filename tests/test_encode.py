import pytest

from featloom.operators import encode as enc
from featloom.sources.specs import read_dictionary, read_feature_spec

# Encoder example (FIXTURES.md section 4).
SCHEMA_LINES = ["col_1", "col_d", "col1_d", "col_m", "label=col_1", "reserve=col_1", "reserve=col_d"]
DATA = ["1,2,3,a:1;b:2"] * 5 + ["2,3,,c:2"]
EXISTING = ["col1_d_:7", "col_m_a:4", "col_m_b:5", "col_d_2:2", "col1_d_3:3", "col_d_3:6", "col_m_c:8"]


def rows(spark, data=DATA):
    return spark.createDataFrame([(i, *line.split(",")) for i, line in enumerate(data)],
                                 "row_id long, col_1 string, col_d string, col1_d string, col_m string")


def test_spec():
    spec = enc.FeatureSpec.from_lines(SCHEMA_LINES)
    assert spec.label == "col_1" and spec.reserves == ["col_1", "col_d"]
    with pytest.raises(ValueError):
        enc.FeatureSpec.from_lines(["a", "label=b"])
    with pytest.raises(ValueError):
        enc.FeatureSpec.from_lines(["a", "label=a", "label=a"])
    with pytest.raises(ValueError):
        enc.FeatureSpec.from_lines(["a", "reserve=a"])


def test_dictionary_from_empty(spark):
    spec = enc.FeatureSpec.from_lines(SCHEMA_LINES)
    d = enc.build_dictionary(enc.feature_entries(rows(spark), spec))
    got = {r.key: r.id for r in d.collect()}
    assert got == {"col_d_2": 1, "col1_d_3": 2, "col_m_a": 3, "col_m_b": 4, "col_d_3": 5, "col1_d_": 6, "col_m_c": 7}
    lines = {r.row_id: r.line for r in enc.encode_lines(rows(spark), spec, d).collect()}
    assert lines[0] == "1 1:1 2:1 3:1 4:2#1\t2"
    assert lines[5] == "2 5:1 6:1 7:2#2\t3"


def test_dictionary_with_existing(spark, scratch):
    path = f"{scratch}/existing.idmap"
    with open(path, "w") as fh:
        fh.write("\n".join(EXISTING + ["broken line", "col_m_c:8"]) + "\n")
    existing = read_dictionary(spark, path)
    spec = enc.FeatureSpec.from_lines(SCHEMA_LINES)
    data = DATA + ["3,2,3,z:4"]
    d = enc.build_dictionary(enc.feature_entries(rows(spark, data), spec), existing=existing)
    got = {r.key: r.id for r in d.collect()}
    assert got["col_m_z"] == 9  # max(id) + 1, never a taken id
    lines = {r.row_id: r.line for r in enc.encode_lines(rows(spark, data), spec, d).collect()}
    assert lines[0] == "1 2:1 3:1 4:1 5:2#1\t2"
    assert lines[5] == "2 6:1 7:1 8:2#2\t3"


def test_dictionary_last_wins(spark, scratch):
    path = f"{scratch}/d.idmap"
    with open(path, "w") as fh:
        fh.write("a:1\nb:2\na:5\nc\n")
    assert {r.key: r.id for r in read_dictionary(spark, path).collect()} == {"a": 5, "b": 2}


def test_ids_dense_across_partitions(spark):
    df = spark.range(0, 5000, numPartitions=7).selectExpr("id * 3 AS r", "cast(id % 5 AS int) AS p")
    out = enc.assign_ids(df.repartition(5), ["r", "p"], start=10)
    got = sorted((r.r, r.id) for r in out.collect())
    assert [i for _, i in got] == list(range(10, 5010))


def test_spec_file(scratch):
    path = f"{scratch}/schema"
    with open(path, "w") as fh:
        fh.write("\n".join(SCHEMA_LINES) + "\n")
    assert read_feature_spec(path).columns == ["col_1", "col_d", "col1_d", "col_m"]


def test_encode_without_broadcast_matches(spark, monkeypatch):
    spec = enc.FeatureSpec.from_lines(SCHEMA_LINES)
    d = enc.build_dictionary(enc.feature_entries(rows(spark), spec))
    want = {r.row_id: r.line for r in enc.encode_lines(rows(spark), spec, d).collect()}
    monkeypatch.setattr(enc, "BROADCAST_MAX_KEYS", 0)  # force the shuffle-join path
    got = {r.row_id: r.line for r in enc.encode_lines(rows(spark), spec, d).collect()}
    assert got == want


def test_checkpoint_dir_comes_from_session(spark):
    from featloom.session import checkpoint_dir
    d = checkpoint_dir(spark)
    assert d and d == spark.sparkContext.getCheckpointDir()


def test_rows_that_share_an_id_stay_apart(spark):
    spec = enc.FeatureSpec.from_lines(SCHEMA_LINES)
    df = spark.createDataFrame([(1, "1", "2", "3", "a:1"), (1, "9", "2", "3", "b:1"), (2, "5", "2", "3", "a:1"), (2, "5", "2", "3", "a:1")],
                               "row_id long, col_1 string, col_d string, col1_d string, col_m string")
    d = enc.build_dictionary(enc.feature_entries(df, spec))
    lines = sorted((r.row_id, r.line.split()[0], r.line.count(":")) for r in enc.encode_lines(df, spec, d).collect())
    assert lines == [(1, "1", 3), (1, "9", 3), (2, "5", 3), (2, "5", 3)]

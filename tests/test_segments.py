"""Dictionary segments and packed maps in parts."""

import random

from pyspark.sql import functions as F

from featloom.functions.mapstr import pack_map
from featloom.operators import encode as enc
from featloom.operators import mapparts as mp
from featloom.operators.dictionary import SegmentedDictionary

ENTRIES = "row_id long, pos int, key string, value string"


def test_segments_grow_without_moving_the_dictionary(spark):
    rnd = random.Random(2)
    rows = [(i, p, f"k{rnd.randrange(60 + i // 2)}", "1") for i in range(300) for p in range(2)]
    first, rest = spark.createDataFrame(rows[:200], ENTRIES), spark.createDataFrame(rows[200:] + [(999, 0, None, "1")], ENTRIES)
    d = SegmentedDictionary(spark, "segments_test", buckets=8)
    d.drop()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = d.grow(first)
        assert {r.key: r.id for r in d.read().collect()} == {r.key: r.id for r in enc.build_dictionary(first).collect()}
        m = d.grow(rest)
        assert d.grow(rest) == 0 and m > 0
        ids = d.read().collect()
        assert sorted(r.id for r in ids) == list(range(1, n + m + 1)) and {r.segment for r in ids} == {0, 1}
        whole = enc.build_dictionary(rest.where("key IS NOT NULL"), existing=enc.build_dictionary(first))
        assert {r.key: r.id for r in ids} == {r.key: r.id for r in whole.collect()}
        for plan in (d.encode(rest), d.unseen(rest.select("key").distinct())):
            text = plan._jdf.queryExecution().executedPlan().toString()
            # Between the table's scan and the join there is a sort within buckets and no exchange.
            assert "Bucketed: true" in text and "Exchange hashpartitioning(key" in text
            assert "Exchange" not in text[:text.index("Bucketed: true")].rsplit("+- Sort", 1)[1]
        assert d.encode(rest).where("id IS NULL").count() == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        d.drop()


def test_parts_join_to_the_packed_text(spark):
    rows = [(u, p, k, k * 3 % 7) for u in (1, 2) for p in (8, 9) for k in range(25 if u == 1 else 3)]
    df = spark.createDataFrame(rows, "uid long, period int, key long, value long").repartition(4)
    parts = mp.pack_parts(df, ["uid", "period"], width=4)
    got = {}
    for r in parts.orderBy("uid", "period", "part").collect():
        assert r.packed.count(":") <= 4
        got.setdefault((r.uid, r.period), []).append(r.packed)
    want = df.groupBy("uid", "period").agg(pack_map(F.map_from_entries(F.collect_list(F.struct("key", "value")))).alias("t")).collect()
    assert {k: ";".join(v) for k, v in got.items()} == {(r.uid, r.period): r.t for r in want}
    assert {len(v) for k, v in got.items() if k[0] == 1} == {7}
    back = mp.unpack_parts(parts, ["uid", "period"], "long")
    assert sorted(map(tuple, back.select("uid", "period", F.col("key").cast("long"), "value").collect())) == sorted(rows)


def test_latest_parts_sum_the_newest_periods(spark):
    rows = [(1, p, k, float(p * 10 + k)) for p in (8, 9, 10, 11) for k in range(6) if (p + k) % 2]
    df = spark.createDataFrame(rows, "uid long, period int, key long, value double")
    out = mp.latest_parts(mp.pack_parts(df, ["uid", "period"], width=2), width=2)
    got = {(r.uid, r.n, r.key): r.value for r in mp.unpack_parts(out, ["uid", "n"]).collect()}
    want = {}
    for n, ps in ((1, (10,)), (2, (10, 9)), (3, (10, 9, 8))):
        for u, p, k, v in rows:
            if p in ps:
                want[(u, n, str(k))] = want.get((u, n, str(k)), 0) + v
    assert got == want

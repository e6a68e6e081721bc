"""Nested users in chunks, positions and the period store."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from featloom.operators import nested as nst
from featloom.operators import periods as per
from featloom.operators import positions as pos
from featloom.operators.store import PeriodStore
from featloom.sources.text import read_lines

EXACT = "decimal(18,6)"  # instalments summed exactly, in any order
T0 = dt.datetime(2016, 8, 1)


@pytest.fixture(scope="module")
def frames(spark):
    rnd = random.Random(3)
    time = lambda: T0 + dt.timedelta(hours=rnd.randrange(24 * 120))
    users = [(i, 20 + i, 1, dt.date(2015, 1, 1), float(i)) for i in range(1, 7)]
    # User 1 holds two thirds of all records, user 6 none, user 99 is unknown.
    who = lambda: rnd.choice([1] * 10 + [2, 3, 4, 5, 99])
    clicks = [(who(), time(), rnd.choice([1, 2, None]), rnd.choice([7, 8])) for _ in range(500)]
    clicks += [clicks[0]] * 30 + [(1, None, 3, 3), (None, T0, 1, 1), (2, None, None, None)]
    orders = [(who(), time().date(), 10.0, rnd.randint(1, 3), rnd.randint(1, 4), 1.0) for _ in range(150)]
    loans = [(who(), time(), 100.0, rnd.choice([1, 3, 12])) for _ in range(150)]
    make = spark.createDataFrame
    return (make(users, "uid long, age int, sex int, active_date date, limit double"),
            make(clicks, "uid long, click_time timestamp_ntz, pid long, param long").repartition(5),
            make(orders, "uid long, buy_date date, price double, number int, cate_id long, discount double").repartition(3),
            make(loans, "uid long, loan_time timestamp_ntz, loan_amount double, plan_num int"))


def key(r):
    return tuple((x is not None, x) for x in r)


def test_chunks_hold_all_records_in_order(frames):
    users, clicks, orders, loans = frames
    size = 25
    rows = nst.nest(users, clicks, orders, loans, size=size).collect()
    assert len({(r.uid, r.chunk_no) for r in rows}) == len(rows) and max(r.chunk_no for r in rows) > 8
    for kind, df in zip(nst.KINDS, (clicks, orders, loans)):
        want = {}
        for r in df.collect():
            want.setdefault(r[0], []).append(tuple(r)[1:])
        for uid in range(1, 7):
            mine = sorted((r for r in rows if r.uid == uid), key=lambda r: r.chunk_no)
            got = [tuple(x) for r in mine for x in r[kind]]
            assert got == sorted(want.get(uid, []), key=key)
            full = [len(r[kind]) for r in mine]
            assert all(n <= size for n in full) and sorted(full, reverse=True) == full and sum(0 < n < size for n in full) <= 1
            for r in mine:
                times = [x[0] for x in r[kind] if x[0] is not None]
                span = (min(times, default=None), max(times, default=None))
                if kind == "orders":
                    span = tuple(t and dt.datetime.combine(t, dt.time()) for t in span)
                assert (r[f"{kind}_from"], r[f"{kind}_to"]) == span
    bare = [r for r in rows if r.uid == 6]
    assert len(bare) == 1 and bare[0].chunk_no == 0 and bare[0].clicks == bare[0].orders == bare[0].loans == []


def test_only_heavy_users_take_the_range_sort(frames, monkeypatch):
    users, clicks, orders, loans = frames
    sums = loans.groupBy("uid").agg(F.sum("loan_amount").alias("loan_sum"))
    sorted_, real = [], nst.dense_positions
    monkeypatch.setattr(nst, "dense_positions", lambda df, *a: sorted_.append({r.uid for r in df.select("uid").distinct().collect()}) or real(df, *a))
    got = [sorted(map(repr, nst.nest(users, clicks, orders, loans, sums, size=25, **kw).collect())) for kw in ({}, {"heavy": 100}, {"heavy": 0})]
    # User 1 holds most records, 99 is unknown; the light ones never meet the range sort.
    assert sorted_ == [{1}, {1, 2, 3, 4, 5}]
    assert got[0] == got[1] == got[2] and len(got[0]) > 10


def test_cut_off_skips_and_passes_whole_chunks(spark, frames, scratch):
    users, clicks, orders, loans = frames
    stored = nst.store(nst.nest(users, clicks, orders, loans, size=10), f"{scratch}/nested")
    cut = nst.cut_off(stored, "2016-10-01 00:00:00")
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(clicks_from,2016-10-01T00:00\)", plan)
    early = dt.datetime(2016, 10, 1)
    for kind, df in zip(nst.KINDS, (clicks, orders, loans)):
        t = nst.KINDS[kind]
        flat = nst.records(cut, kind).collect()
        want = [r for r in df.collect() if r[t] is not None and (r[t] < early if kind != "orders" else r[t] < early.date()) and r.uid in range(1, 7)]
        assert sorted(map(key, flat)) == sorted(map(key, want))
        got = cut.agg(F.max(f"{kind}_to")).first()[0]
        assert got < early
    assert {r.uid for r in cut.where("chunk_no = 0").collect()} == set(range(1, 7))


def test_wide_rows_over_chunks_equal_flat_ones(frames, scratch):
    users, clicks, orders, loans = frames
    sums = loans.groupBy("uid").agg(F.sum("loan_amount").alias("loan_sum"))
    nested = nst.store(nst.nest(users, clicks, orders, loans, sums, size=20), f"{scratch}/nested")
    flat = per.wide_features(users, clicks, orders, loans, sums, per_plan_type=EXACT)
    got = nst.wide_features(nested, per_plan_type=EXACT)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Generate inline", plan)) == 3 and "partial_count" in plan
    assert got.columns == flat.columns and sorted(got.collect(), key=key) == sorted(flat.collect(), key=key)


def test_month_filter_and_empty_tables(spark, frames):
    users, clicks, orders, loans = frames
    rows = nst.nest(users, clicks, orders, loans, before_month=9).collect()
    assert {x.click_time.month for r in rows for x in r.clicks} == {8}
    none = nst.nest(users, *[df.limit(0) for df in (clicks, orders, loans)])
    assert [r.clicks for r in none.collect()] == [[]] * 6
    assert nst.nest(users.limit(0), clicks, orders, loans).count() == 0


def test_positions(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None, "c"]) if i % 3 else "hot", rnd.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, _idx long").repartition(7)
    got = pos.dense_positions(df, ["k"], ["v", "_idx"], partitions=9).collect()
    assert len(got) == 3000 and got[0].__fields__ == ["k", "v", "_idx", "pos"]
    for k in ("a", "b", None, "c", "hot"):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(len(mine)))
        assert [(r.v, r[2]) for r in mine] == sorted((r.v, r[2]) for r in mine)
    whole = pos.dense_positions(df, [], ["v"]).collect()
    assert sorted(r.pos for r in whole) == list(range(3000))
    same = spark.createDataFrame([("x",)] * 500, "k string").repartition(4)
    assert sorted(r.pos for r in pos.dense_positions(same, ["k"], []).collect()) == list(range(500))
    assert pos.dense_positions(df.limit(0), ["k"], ["v"]).count() == 0
    with pytest.raises(ValueError):
        pos.dense_positions(df, [], ["k"], name="v")


def test_a_hot_key_is_many_partitions(spark):
    df = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    plan = pos.dense_positions(df, ["k"], ["id"], partitions=8)
    assert plan.select(F.spark_partition_id().alias("p")).groupBy("p").count().agg(F.max("count")).first()[0] < 2000


def test_line_positions_over_files_and_splits(spark, scratch):
    for f in range(3):
        with open(f"{scratch}/part-{f}.txt", "w") as out:
            out.writelines(f"file {f} line {i}\n" for i in range(400))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        lines = read_lines(spark, f"{scratch}/*.txt")
        assert lines.rdd.getNumPartitions() > 6
        got = pos.line_positions(lines).select("pos", "value").orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in got] == [f"file {f} line {i}" for f in range(3) for i in range(400)]
    assert [r.pos for r in got] == list(range(1200))


def test_attach_by_position(spark):
    left = spark.createDataFrame([(i, f"l{i}") for i in range(50)], "id long, name string").repartition(4)
    right = spark.createDataFrame([(100 - i, float(i)) for i in range(40)], "at long, v double").repartition(3)
    got = pos.attach_by_position(left, right, ["v"], ["id"], ["at"]).orderBy("pos").collect()
    assert [(r.id, r.v) for r in got] == [(i, float(39 - i)) for i in range(40)]


def _files(path):
    import os
    return {os.path.relpath(os.path.join(d, f), path): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_store_grows_by_a_month_and_takes_late_rows(spark, frames, scratch):
    users, clicks, orders, loans = frames
    clicks = clicks.where("uid IS NOT NULL AND click_time IS NOT NULL")
    like = {"clicks": clicks, "orders": orders, "loans": loans}
    time = {"clicks": "click_time", "orders": "buy_date", "loans": "loan_time"}
    whole = sorted(per.wide_features(users, clicks, orders, loans, per_plan_type=EXACT).collect(), key=key)
    store = PeriodStore(spark, f"{scratch}/store", per_plan_type=EXACT)
    assert store.wide(users, like).count() == 6
    late = F.col("uid") == 1
    for m in (8, 9, 10):
        store.add(f"m{m}", **{k: df.where((F.month(time[k]) == m) & ~(late & F.lit(m == 9))) for k, df in like.items()})
    before = _files(scratch)
    store.add("m11", **{k: df.where((F.month(time[k]) == 11) | (late & (F.month(time[k]) == 9))) for k, df in like.items()})
    after = _files(scratch)
    # Only partitions of the new batch were written: its own month, and the late month under its name.
    assert {f: t for f, t in after.items() if "batch=m11" not in f} == before
    assert {re.search(r"period=(\d+)", f)[1] for f in after if "batch=m11" in f} == {"9", "11"}
    assert sorted(store.wide(users, like).collect(), key=key) == whole
    # The same batch again counts once, also with fewer rows.
    store.add("m11", clicks=clicks)
    store.add("m11", **{k: df.where((F.month(time[k]) == 11) | (late & (F.month(time[k]) == 9))) for k, df in like.items()})
    assert sorted(store.wide(users, like).collect(), key=key) == whole
    for kind in like:
        states = store._states(kind, like[kind])
        store.compact(kind, 9, states, "all")
        store.compact(kind, 9, states, "all")
    assert {b for p, b in store._folders("clicks") if p == "9"} == {"all"}
    assert sorted(store.wide(users, like).collect(), key=key) == whole

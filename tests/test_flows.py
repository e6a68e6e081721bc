"""End-to-end jobs on CSV files written from the sf0.001 test tables."""

import os

import pytest
from pyspark.sql import functions as F

from featloom.operators import periods as per
from featloom.plans import flows
from featloom.plans import tables as t

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def write_csv(df, path):
    (df.coalesce(1).write.mode("overwrite").option("header", True).option("dateFormat", "yyyy-M-d")
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path))
    return path


@pytest.fixture(scope="module")
def csv_tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("csv"))
    orders = t.orders(spark, SF)
    price = F.when((orders.order_key + orders.line_number) % 10 == 0, F.lit(None)).otherwise(orders.price)
    paths = {
        "user": write_csv(t.users(spark, SF), f"{d}/user"),
        "click": write_csv(t.clicks(spark, SF), f"{d}/click"),
        "order": write_csv(orders.select("uid", "buy_date", price.alias("price"), "number", "cate_id", "discount"),
                           f"{d}/order"),
        "loan": write_csv(t.loans(spark, SF), f"{d}/loan"),
        "loan_sum": write_csv(t.loan_sums(spark, SF), f"{d}/loan_sum"),
    }
    tables = flows.convert_csv_tables(spark, paths, f"{d}/tables")
    return d, tables


def test_convert_and_wide(spark, csv_tables):
    d, tables = csv_tables
    assert set(tables) == {"user", "click", "order", "loan", "loan_sum"}
    wide = flows.build_wide(spark, f"{d}/tables", f"{d}/wide")
    ref = per.wide_features(t.users(spark, SF), t.clicks(spark, SF), t.orders(spark, SF), t.loans(spark, SF),
                            t.loan_sums(spark, SF), per_plan_type=t.PER_PLAN)
    assert wide.count() == ref.count()
    a = {r.uid: r for r in wide.collect()}
    for r in ref.collect():
        w = a[r.uid]
        assert (w.orderNum8, w.loanNum10, w.clickNum9) == (r.orderNum8, r.loanNum10, r.clickNum9)
        assert w.loanAmount9 == pytest.approx(float(r.loanAmount9))
        assert w.loanSum == pytest.approx(float(r.loanSum))


def test_trailing_samples_snapshots(spark, csv_tables):
    d, _ = csv_tables
    flows.build_wide(spark, f"{d}/tables", f"{d}/wide2")
    flows.trailing_text(spark, f"{d}/wide2", f"{d}/trailing", num_files=1)
    lines = [r.value for r in spark.read.text(f"{d}/trailing").collect()]
    assert len(lines) == spark.read.parquet(f"{d}/wide2").count()
    assert all(len(x.split(",")) == 90 for x in lines)
    uids = [int(x.split(",")[0]) for x in lines]
    assert uids == sorted(uids)
    paths = flows.month_sample_text(spark, f"{d}/wide2", f"{d}/samples")
    assert set(paths) == {"month8", "month9", "month10", "month11", "nov_step2", "dec_step2"}
    first = spark.read.text(paths["month11"]).first().value
    assert first.startswith("0 ")
    snaps = flows.build_snapshots(spark, f"{d}/tables", f"{d}/snap")
    users = spark.read.parquet(snaps["users"])
    assert users.count() == 3 * spark.read.parquet(f"{d}/tables/user").count()
    recs = spark.read.parquet(snaps["orders"]).where("snapshot_month = 10")
    n_before = users.where("snapshot_month = 10").agg(F.sum("n_orders")).first()[0]
    assert recs.count() == n_before


def test_fanout_and_encode_jobs(spark, csv_tables, scratch):
    d, _ = csv_tables
    wide = flows.build_wide(spark, f"{d}/tables", f"{d}/wide3")
    cols = ["uid", "age", "sex", "active_date", "limit"] + [f"clickNum{p}" for p in (8, 9, 10, 11)]
    for p in (8, 9, 10, 11):
        cols += [f"orderNum{p}", f"orderAmount{p}"]
    for p in (8, 9, 10, 11):
        cols += [f"loanNum{p}", f"loanAmount{p}"]
    cols.append("loanSum")
    rows = wide.select(F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("line"))
    from featloom import sinks
    sinks.write_lines(rows.unionByName(wide.limit(1).select(F.lit("1,2,3").alias("line"))), f"{scratch}/rows26")
    rejects = flows.fanout_text(spark, f"{scratch}/rows26", f"{scratch}/fan")
    assert rejects.count() == 1
    assert spark.read.text(f"{scratch}/fan").count() == 3 * wide.count()

    with open(f"{scratch}/data", "w") as fh:
        fh.write("\n".join(["1,2,3,a:1;b:2"] * 5 + ["2,3,,c:2", "bad,line"]) + "\n")
    with open(f"{scratch}/schema", "w") as fh:
        fh.write("col_1\ncol_d\ncol1_d\ncol_m\nlabel=col_1\nreserve=col_1\nreserve=col_d\n")
    out = flows.encode_text(spark, f"{scratch}/data", f"{scratch}/schema", f"{scratch}/enc")
    got = [r.value for r in spark.read.text(out["lines"]).collect()]
    assert sorted(got) == sorted(["1 1:1 2:1 3:1 4:2#1\t2"] * 5 + ["2 5:1 6:1 7:2#2\t3"])
    assert spark.read.text(out["rejects"]).first().value == "bad,line"
    assert spark.read.text(out["idmap"]).count() == 7


def test_train_and_score(spark, csv_tables):
    d, _ = csv_tables
    r = flows.train_and_score(spark, f"{d}/tables")
    assert r["n_validation"] > 0 and r["rmse_zero"] >= 0 and r["rmse_model"] >= 0
    assert len(r["coefficients"]) == 6


def test_encode_job_reuses_parquet_dictionary_with_colon_keys(spark, scratch):
    with open(f"{scratch}/data", "w") as fh:
        fh.write("1,a:b,x:1\n2,c,y:2\n")
    with open(f"{scratch}/schema", "w") as fh:
        fh.write("lab\nv_d\nm_m\nlabel=lab\n")
    first = flows.encode_text(spark, f"{scratch}/data", f"{scratch}/schema", f"{scratch}/enc1")
    ids = {r.key: r.id for r in spark.read.parquet(first["idmap_parquet"]).collect()}
    assert "v_d_a:b" in ids  # survives in the Parquet form
    with open(f"{scratch}/data2", "w") as fh:
        fh.write("3,a:b,z:5\n")
    second = flows.encode_text(spark, f"{scratch}/data2", f"{scratch}/schema", f"{scratch}/enc2",
                               existing_idmap=first["idmap_parquet"], existing_format="parquet")
    line = spark.read.text(second["lines"]).first().value
    assert line == f"3 {ids['v_d_a:b']}:1 {max(ids.values()) + 1}:5#"

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from featloom import sinks
from featloom.sources import csv as csvsrc
from featloom.sources.specs import read_column_names
from featloom.sources.text import parse_delimited, read_lines


def write(path, text):
    with open(path, "w") as fh:
        fh.write(text)
    return path


def test_csv_tables(spark, scratch):
    u = csvsrc.read_users(spark, write(f"{scratch}/u.csv", "uid,age,sex,active_date,limit\n1,30,1,2016-1-5,5.5\n"))
    r = u.first()
    assert (r.uid, r.age, r.active_date, r.limit) == (1, 30, dt.date(2016, 1, 5), 5.5)
    c = csvsrc.read_clicks(spark, write(f"{scratch}/c.csv", "uid,click_time,pid,param\n1,2016-08-01 10:11:12,7,4\n"))
    assert c.first().click_time == dt.datetime(2016, 8, 1, 10, 11, 12)
    o = csvsrc.read_orders(spark, write(f"{scratch}/o.csv",
                                         "uid,buy_date,price,number,cate_id,discount\n1,2016-8-3,,2,5,0\n1,2016-8-3,2.5,2,5,0\n"))
    assert sorted(r.price for r in o.collect()) == [-1.0, 2.5]
    ln = csvsrc.read_loans(spark, write(f"{scratch}/l.csv", "uid,loan_time,loan_amount,plan_num\n1,2016-08-01 00:00:00,9.5,3\n"))
    assert ln.first().plan_num == 3
    ls = csvsrc.read_loan_sums(spark, write(f"{scratch}/s.csv", "uid,month,loan_sum\n1,2016-11,4.5\n"))
    assert ls.columns == ["uid", "loan_sum"] and ls.first().loan_sum == 4.5


def test_csv_failfast(spark, scratch):
    bad = csvsrc.read_users(spark, write(f"{scratch}/bad.csv", "h\n1,30,1,2016-13-45,5.5\n"))
    with pytest.raises(Exception):
        bad.collect()


@pytest.mark.parametrize("reader, line", [
    (csvsrc.read_users, "1,,1,2016-1-5,5.5"), (csvsrc.read_users, "1,30,1,2016-1-5,"),
    (csvsrc.read_clicks, "1,2016-08-01 10:11:12,,4"), (csvsrc.read_orders, "1,2016-8-3,2.5,,5,0"),
    (csvsrc.read_loans, ",2016-08-01 00:00:00,9.5,3"), (csvsrc.read_loan_sums, "1,2016-11,")])
def test_empty_required_field_fails(spark, scratch, reader, line):
    with pytest.raises(Exception, match="required field"):
        reader(spark, write(f"{scratch}/empty.csv", f"h\n{line}\n")).collect()


def test_parse_delimited_rejects(spark):
    lines = spark.createDataFrame([(1, "1,2016-8-3,,2"), (2, "1,2"), (3, "1,2016-8-4,3.5,1"), (4, "a,b,c,d,e")],
                                  "k long, value string")
    good, bad = parse_delimited(lines, "uid long, d date, price double, n int", keep=["k"], defaults={"price": -1})
    g = {r.k: r for r in good.collect()}
    assert set(g) == {1, 3} and g[1].price == -1.0 and g[3].d == dt.date(2016, 8, 4)
    assert sorted((r.k, r.n_fields) for r in bad.collect()) == [(2, 2), (4, 5)]


def test_lines_and_column_names(spark, scratch):
    write(f"{scratch}/names", "uid long\nage int\n\nlimit double\n")
    assert read_column_names(f"{scratch}/names") == ["uid", "age", "limit"]
    df = read_lines(spark, write(f"{scratch}/lines.txt", "b\na\nc\n"))
    assert [r.value for r in df.orderBy("line_order").collect()] == ["b", "a", "c"]


def test_sinks(spark, scratch):
    df = spark.createDataFrame([(2, "y", 9), (1, "x", 10)], "k long, line string, m int")
    sinks.write_parquet(df, f"{scratch}/p", partition_by="m")
    sinks.write_parquet(df, f"{scratch}/p", partition_by="m")  # overwrite
    assert spark.read.parquet(f"{scratch}/p").count() == 2
    sinks.write_lines(df, f"{scratch}/t", order_by="k", num_files=1)
    files = [f for f in os.listdir(f"{scratch}/t") if f.startswith("part-")]
    assert open(f"{scratch}/t/{files[0]}").read().splitlines() == ["x", "y"]
    d = spark.createDataFrame([("a", 1), ("b", 2)], "key string, id long")
    sinks.write_dictionary(d, f"{scratch}/idmap")
    assert sorted(r.value for r in spark.read.text(f"{scratch}/idmap").collect()) == ["a:1", "b:2"]


def test_typed_parquet_reader(spark, scratch):
    from featloom.schemas import USER_SCHEMA
    from featloom.sources.parquet import load_table
    df = spark.createDataFrame([(1, 30, 1, dt.date(2016, 1, 1), 5.0)], USER_SCHEMA)
    sinks.write_parquet(df, f"{scratch}/users")
    back = load_table(spark, f"{scratch}/users", USER_SCHEMA)
    assert back.schema == USER_SCHEMA and back.count() == 1


def test_trailing_schema_names():
    from featloom.operators.latest import latest_columns
    names = sinks.trailing_schema(latest_columns(), existing=["uid", "age"])
    assert names[:3] == ["uid", "age", "clickNum10Latest1Month"] and len(names) == 38


def test_column_names_round_trip(spark, scratch):
    from featloom.operators.latest import latest_columns
    names = sinks.trailing_schema(latest_columns(), existing=["uid", "age"])
    sinks.write_column_names(spark, names, f"{scratch}/schema_out")
    assert read_column_names(f"{scratch}/schema_out") == names

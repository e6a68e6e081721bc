import pytest
from pyspark.sql import functions as F

from featloom.operators import samples as smp
from featloom.operators import latest as lat

from golden import golden_wide


def test_month_sample_golden(spark):
    line = smp.sample_lines(golden_wide(spark), smp.month_sample(8, label=True)).first().line
    assert line == "0.0 705:1 795:1 443:5.9746772897 464:63.0 922:8.0 208:34.006860179 856:0.0 886:0.0"


def test_nov_dec_samples(spark):
    w = golden_wide(spark)
    nov = smp.sample_lines(w, smp.month_sample(9, label="loanSum")).first().line
    assert nov.startswith("0.0 705:1 795:1 443:5.9746772897 463:28.0 923:10.0 209:15.784738593500002")
    dec = smp.sample_lines(w, smp.month_sample(10, label=False)).first().line
    assert dec.startswith("0 705:1 795:1 443:") and " 462:23.0 924:4.0 " in dec


def test_labelled_last_period_rejected():
    with pytest.raises(ValueError):
        smp.month_sample(11, label=True)


def test_fanout(spark):
    out = smp.fanout_samples(golden_wide(spark)).orderBy("period").collect()
    assert [r.period for r in out] == [8, 9, 10]
    assert out[0].line.split(" ")[:4] == ["0.0", "128:1", "629:1", "893:5.9746772897"]
    assert out[0].line.split(" ")[4] == "120:63"


def test_raw_line_and_trailing_line(spark):
    w = golden_wide(spark)
    line = w.select(smp.raw_line(w).alias("l")).first().l
    parts = line.split(",")
    assert len(parts) == 54
    assert parts[:9] == ["38926", "35", "1", "2016-1", "5.9746772897", "63", "28", "23", "27"]
    assert parts[9] == "7:1;1:20;10:39;9:3" and parts[53] == "0.0"
    full = lat.latest_map(lat.latest_numeric(w))
    tl = full.select(smp.trailing_line(full).alias("l")).first().l.split(",")
    assert len(tl) == 90 and tl[54] == "23.0" and tl[55] == "51.0"


def test_wide_text_round_trip(spark):
    from featloom.schemas import wide_text_schema
    from featloom.sources.text import parse_delimited
    w = golden_wide(spark)
    lines = w.select(smp.raw_line(w).alias("value"))
    parsed, rejects = parse_delimited(lines, wide_text_schema())
    assert rejects.count() == 0
    a = lat.latest_numeric(parsed).first()
    b = lat.latest_numeric(w).first()
    assert a["orderAmount8Latest3Month"] == b["orderAmount8Latest3Month"]
    assert a["clickPage8"] == "7:1;1:20;10:39;9:3" and a["active_date"] == "2016-1"


def test_a_null_is_an_empty_field(spark):
    w = golden_wide(spark)
    full = w.select(smp.raw_line(w).alias("line")).first().line
    w = w.withColumn("limit", F.lit(None).cast("double"))
    line = w.select(smp.raw_line(w).alias("line")).first().line
    assert line.count(",") == full.count(",") and line.split(",")[4] == ""

"""Input columns named like the helpers of op5 and op6."""

from pyspark.sql import functions as F

from featloom.llm import line_dedup, quality


def test_helper_names_in_the_input(spark, docs):
    names = ["wh", "g2", "g4", "_t", "_w", "_n", "_s", "_lines", "did", "th", "_gone", "_l", "_in", "_row"]
    plain = docs.select("doc_id", "text")
    wide = plain.withColumns({n: F.lit(f"own {n}") for n in names})
    labels = spark.createDataFrame([(0, 1)], "doc_id long, quality int")
    for run in (lambda d: quality.run(d, labels), line_dedup.dedup):
        want, got = run(plain), run(wide)
        assert sorted(map(tuple, got.select(want.columns).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
        assert got.select(*names).distinct().collect() == [tuple(f"own {n}" for n in names)]

import pytest
from pyspark.sql import functions as F

from featloom.operators import model as mdl


def test_split_disjoint_complete_repeatable(spark):
    df = spark.range(0, 2000).withColumnRenamed("id", "uid")
    a = mdl.hash_split(df, "uid")
    b = mdl.hash_split(df, "uid")
    assert a.count() == 2000
    train = {r.uid for r in a.where("is_train").collect()}
    valid = {r.uid for r in a.where("not is_train").collect()}
    assert not train & valid and len(train | valid) == 2000
    assert train == {r.uid for r in b.where("is_train").collect()}
    assert 0.85 < len(train) / 2000 < 0.95


def test_rmse(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 0.0)], "l double, p double")
    r = mdl.rmse(df, "p", "l").first()
    assert r.n == 2 and r.rmse == pytest.approx((5.0) ** 0.5)
    assert mdl.rmse(df.where("l > 10"), "p", "l").first().rmse is None


def test_linear_fit_exact_line(spark):
    df = spark.range(0, 50).select(F.col("id").cast("double").alias("x"), (F.col("id") * 3 + 2).cast("double").alias("y"))
    m = mdl.fit_linear(df, ["x"], "y", fit_intercept=True)
    assert m.coefficients[0] == pytest.approx(3.0) and m.intercept == pytest.approx(2.0)


def test_numeric_user_features(spark):
    import datetime as dt
    df = spark.createDataFrame([(30, 5.0, 1, dt.date(2016, 3, 7))], "age int, limit double, sex int, active_date date")
    r = mdl.numeric_user_features(df).first()
    assert (r.f_year, r.f_month, r.f_day) == (116.0, 2.0, 7.0)


def test_rmse_many_one_pass(spark):
    df = spark.createDataFrame([(1.0, 1.5), (3.0, 2.0)], "l double, p double")
    r = mdl.rmse_many(df, "l", {"zero": F.lit(0.0), "model": "p"}).first()
    assert r.n == 2 and r.rmse_zero == pytest.approx(5.0 ** 0.5)
    assert r.rmse_model == pytest.approx(((0.25 + 1.0) / 2) ** 0.5)


def test_grid_sweep_small(spark):
    df = spark.range(0, 60).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    res = mdl.grid_sweep(df, ["x"], "y", step_sizes=(0.3,), depths=(2,), max_iter=3, parallelism=1)
    assert len(res) == 1 and res[0][1] >= 0


def test_grid_sweep_default_is_the_whole_reference_grid(spark):
    import itertools
    df = spark.range(0, 60).coalesce(1).select(F.col("id").cast("double").alias("x"), (F.col("id") * 2.0).alias("y"))
    res = mdl.grid_sweep(df, ["x"], "y", max_iter=1)
    names = ("stepSize", "minInfoGain", "minInstancesPerNode", "maxDepth")
    got = [tuple({k.name: v for k, v in p.items()}[n] for n in names) for p, _ in res]
    want = set(itertools.product((0.01, 0.1, 0.5, 1.0), (0.01, 0.1, 0.5, 1.0), (1, 5), (3, 6)))
    assert len(got) == 64 and set(got) == want and all(r >= 0 for _, r in res)


def test_grid_sweep_shares_a_fit_only_where_it_is_the_same(spark, monkeypatch):
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import TrainValidationSplit
    # Gains on both sides of 0.5 and 5; with a few outliers, leaves of fewer than 5 rows.
    df = spark.range(0, 200).coalesce(1).select(F.col("id").cast("double").alias("x"),
                                                (F.col("id") % 7 + F.when(F.col("id") % 50 == 3, 40).otherwise(0)).cast("double").alias("y"))
    lists = {"step_sizes": (0.1, 1.0), "min_info_gain": (0.01, 0.02, 0.5, 5.0), "min_instances": (1, 5), "depths": (3,)}
    fits, real = [], mdl._sweep
    monkeypatch.setattr(mdl, "_sweep", lambda e, grid, *a: fits.extend(grid) or real(e, grid, *a))
    got = mdl.grid_sweep(df, ["x"], "y", **lists, max_iter=2)
    assert len(got) == 16 and 2 < len(fits) < 16
    data = mdl.assemble(df, ["x"]).select("features", F.col("y").alias("label"))
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=2, seed=7)
    plain = TrainValidationSplit(estimator=gbt, estimatorParamMaps=[{gbt.getParam(k.name): v for k, v in p.items()} for p, _ in got],
                                 trainRatio=0.9, seed=7, evaluator=RegressionEvaluator(metricName="rmse"))
    assert [m for _, m in got] == pytest.approx(plain.fit(data).validationMetrics, rel=1e-9)
    assert len({round(m, 9) for _, m in got}) > 2

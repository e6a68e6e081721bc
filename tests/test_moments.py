"""Gradient steps and folds from sums, against the trainer of Spark's RDD library and plain refits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.operators import model as mdl
from featloom.operators import moments as mom


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(8)
    x = np.round(rnd.standard_normal((400, 3)) * [1, 30, 4], 2)
    y = np.round(x @ [2.0, -0.5, 3.0] + rnd.standard_normal(400), 2)
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "uid long, a double, b double, c double, y double")
    return x, y, df.select("uid", *[F.col(c).cast("decimal(18,2)").alias(c) for c in "abcy"]).repartition(5)


@pytest.mark.parametrize("settings", [dict(), dict(steps=40, step_size=1e-3, tolerance=1e-6), dict(steps=1, step_size=1e-3), dict(steps=30, step_size=1e-3, tolerance=0.0)])
def test_steps_equal_the_library_trainer(spark, data, settings):
    from pyspark.mllib.regression import LabeledPoint, LinearRegressionWithSGD

    x, y, df = data
    got = mom.fit_steps(df, ["a", "b", "c"], "y", **settings).first()
    points = spark.sparkContext.parallelize([LabeledPoint(float(t), [float(c) for c in v]) for v, t in zip(x, y)], 3)
    s = dict(steps=mom.STEPS, step_size=mom.STEP_SIZE, tolerance=mom.TOLERANCE) | settings
    want = LinearRegressionWithSGD.train(points, iterations=s["steps"], step=s["step_size"], convergenceTol=s["tolerance"])
    assert got.weights == pytest.approx(list(want.weights), rel=1e-9)
    assert got.n == 400 and got.rmse_zero == pytest.approx(np.sqrt(np.mean(y**2)))
    assert got.rmse_model == pytest.approx(np.sqrt(np.mean((x @ got.weights - y) ** 2)), rel=1e-9)


def test_folds_equal_refits(data):
    x, y, df = data
    settings = dict(steps=30, step_size=1e-3)
    out = {r.fold: r for r in mom.cross_validate(df, "uid", ["a", "b", "c"], "y", folds=4, **settings).collect()}
    fold = {r.uid: r.fold for r in df.select("uid", mom.fold_of("uid", 4).alias("fold")).collect()}
    assert set(out) == set(fold.values()) == {0, 1, 2, 3} and sum(r.n_valid for r in out.values()) == 400
    rest = mdl.hash_split(df, "uid").select("uid", "bucket").collect()
    assert all(fold[r.uid] == r.bucket * 4 // 1000 for r in rest)
    for f, r in out.items():
        again = mom.fit_steps(df.where(mom.fold_of("uid", 4) != f), ["a", "b", "c"], "y", **settings).first()
        assert r.weights == pytest.approx(again.weights, rel=1e-12) and (r.n_train, r.steps) == (again.n, again.steps)
        here = np.array([fold[i] == f for i in range(400)])
        assert r.rmse_model == pytest.approx(np.sqrt(np.mean((x[here] @ r.weights - y[here]) ** 2)), rel=1e-9)


def test_one_scan_and_no_refit(data, spark):
    plan = mom.cross_validate(data[2], "uid", ["a", "b", "c"], "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == 1 and "partial_sum" in plan


def test_nulls_and_no_rows(spark):
    schema = "uid long, a decimal(18,2), y decimal(18,2)"
    none = mom.fit_steps(spark.createDataFrame([], schema), ["a"], "y").first()
    assert (none.n, none.steps, none.weights, none.rmse_zero, none.rmse_model) == (0, 0, [0.0], None, None)
    from decimal import Decimal
    some = spark.createDataFrame([(1, Decimal(1), None), (2, None, Decimal(1)), (3, Decimal(2), Decimal(4))], schema)
    assert mom.fit_steps(some, ["a"], "y", steps=1, step_size=0.1).first().weights == [pytest.approx(0.8)]

"""Model-side operators: features, split, linear fit, RMSE, grid sweep."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.functions.hashing import sha1_bucket_col
from featloom.functions.numeric import squared_error
from featloom.session import delete_path, scratch_path


def numeric_user_features(users: DataFrame) -> DataFrame:
    """``[age, limit, sex, year-1900, month0, day]`` from the user row."""
    d = F.col("active_date")
    return users.select(
        "*",
        F.col("age").cast("double").alias("f_age"), F.col("limit").cast("double").alias("f_limit"),
        F.col("sex").cast("double").alias("f_sex"), (F.year(d) - 1900).cast("double").alias("f_year"),
        (F.month(d) - 1).cast("double").alias("f_month"), F.dayofmonth(d).cast("double").alias("f_day"))


USER_FEATURES = ("f_age", "f_limit", "f_sex", "f_year", "f_month", "f_day")


def split_marker(key, buckets: int = 1000, train_below: int = 900) -> tuple[Column, Column]:
    """M2: a repeatable 90/10 marker from the SHA-1 bucket of the key."""
    b = sha1_bucket_col(key, n=buckets)
    return b, b < F.lit(train_below)


def hash_split(df: DataFrame, key: str, buckets: int = 1000, train_below: int = 900) -> DataFrame:
    """L1 + F7: adds ``bucket`` and ``is_train``; train and validation are
    disjoint and together complete, and the split is the same on every run
    (the reference's random marker is neither, SURVEY D4)."""
    b, t = split_marker(key, buckets, train_below)
    return df.withColumn("bucket", b).withColumn("is_train", t)


def rmse(df: DataFrame, prediction, label) -> DataFrame:
    """A13 + A14 + M12: ``n`` and ``sqrt(sum((p - l)^2) / n)``; null when empty.

    Squared errors are summed in the input type (exact for decimals) before
    the final division and root.
    """
    p = F.col(prediction) if isinstance(prediction, str) else prediction
    lab = F.col(label) if isinstance(label, str) else label
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.sum(squared_error(p, lab)).alias("_sse"))
    return agg.select("n", F.when(F.col("n") > 0, F.sqrt(F.col("_sse").cast("double") / F.col("n")))
                      .alias("rmse"))


def rmse_many(df: DataFrame, label, predictions: dict) -> DataFrame:
    """A13 for several predictions of the same rows in one pass: ``n, rmse_{name}...``."""
    lab = F.col(label) if isinstance(label, str) else label
    sums = []
    for name, p in predictions.items():
        d = (F.col(p) if isinstance(p, str) else p) - lab
        sums.append(F.sum(d * d).alias(f"_sse_{name}"))
    agg = df.agg(F.count(F.lit(1)).alias("n"), *sums)
    return agg.select("n", *[F.when(F.col("n") > 0, F.sqrt(F.col(f"_sse_{name}").cast("double") / F.col("n")))
                             .alias(f"rmse_{name}") for name in predictions])


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def fit_linear(train: DataFrame, features: Sequence[str], label: str, fit_intercept: bool = False,
               reg_param: float = 0.0):
    """L2: least squares, without an intercept unless asked for (normal equations: statistics aggregated on executors)."""
    from pyspark.ml.regression import LinearRegression
    data = assemble(train, features).select("features", F.col(label).cast("double").alias("label"))
    lr = LinearRegression(featuresCol="features", labelCol="label", solver="normal",
                          fitIntercept=fit_intercept, regParam=reg_param, standardization=False)
    return lr.fit(data)


def score(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """L3: predictions next to the rows."""
    return model.transform(assemble(df, features))


#: The reference's whole grid after the parameter mapping: 64 fits.
REFERENCE_GRID = {"step_sizes": (0.01, 0.1, 0.5, 1.0), "min_info_gain": (0.01, 0.1, 0.5, 1.0),
                  "min_instances": (1, 5), "depths": (3, 6)}


def _least_split(model) -> tuple[float, float]:
    """Over all splits of a boosted model: the least gain, and the rows of the smallest child."""
    gain = rows = float("inf")
    nodes = [t._java_obj.rootNode() for t in model.trees]
    while nodes:
        node = nodes.pop()
        if node.subtreeDepth():
            children = [node.leftChild(), node.rightChild()]
            gain, rows = min(gain, node.gain()), min(rows, *(c.impurityStats().count() for c in children))
            nodes += children
    return gain, rows


def _sweep(estimator, grid: Sequence[dict], data: DataFrame, seed: int, parallelism: int):
    """One ``TrainValidationSplit`` over ``grid``: its metrics and its models."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.tuning import TrainValidationSplit
    model = TrainValidationSplit(estimator=estimator, estimatorParamMaps=list(grid), trainRatio=0.9, seed=seed, collectSubModels=True,
                                 evaluator=RegressionEvaluator(metricName="rmse"), parallelism=parallelism).fit(data)
    return model.validationMetrics, model.subModels


def grid_sweep(train: DataFrame, features: Sequence[str], label: str,
               step_sizes=None, min_info_gain=None, min_instances=None, depths=None,
               max_iter: int = 10, parallelism: int | None = None, seed: int = 7):
    """L4: a parameter grid of gradient-boosted trees, each scored by RMSE.

    Parameters stand in for the reference's external grid (eta, gamma,
    min_child_weight, depth).  Without any list the whole ``REFERENCE_GRID`` is
    swept; otherwise a parameter without a list keeps the estimator's default.
    As many fits run at a time as the cluster has cores (at most 8), unless
    ``parallelism`` is given.  Returns ``(params, rmse)`` pairs from a
    ``TrainValidationSplit`` whose fits run on the cluster.

    The rows are staged once, in as many partitions as their size and the cores ask for.
    A least gain or least child size only forbids splits.  So a fit whose every split
    also keeps to the stricter limits of another combination is that combination's fit,
    too; each (step size, depth) is fitted from its loosest limits on, until every
    combination has its model.
    """
    from pyspark.ml.regression import GBTRegressor
    from pyspark.ml.tuning import ParamGridBuilder
    spark = train.sparkSession
    path = scratch_path(spark, "grid-rows")
    rows = train.select(*[F.col(f).alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("label"))
    rows.write.parquet(path)
    data = assemble(spark.read.schema(rows.schema).parquet(path), [f"f{i}" for i in range(len(features))]).select("features", "label")
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=max_iter, seed=seed)
    lists = {"step_sizes": step_sizes, "min_info_gain": min_info_gain, "min_instances": min_instances, "depths": depths}
    if all(v is None for v in lists.values()):
        lists = REFERENCE_GRID
    swept = {"step_sizes": gbt.stepSize, "min_info_gain": gbt.minInfoGain, "min_instances": gbt.minInstancesPerNode, "depths": gbt.maxDepth}
    builder = ParamGridBuilder()
    for name, param in swept.items():
        builder.addGrid(param, [gbt.getOrDefault(param)] if lists[name] is None else list(lists[name]))
    grid = builder.build()
    limits = [(p[gbt.minInfoGain], p[gbt.minInstancesPerNode]) for p in grid]
    same = [(p[gbt.stepSize], p[gbt.maxDepth]) for p in grid]
    found: dict[int, float] = {}
    while len(found) < len(grid):
        open_ = [i for i in range(len(grid)) if i not in found]
        loosest = [min((i for i in open_ if same[i] == k), key=limits.__getitem__) for k in dict.fromkeys(same[i] for i in open_)]
        metrics, models = _sweep(gbt, [grid[i] for i in loosest], data, seed, parallelism or min(8, spark.sparkContext.defaultParallelism))
        for i, metric, model in zip(loosest, metrics, models):
            most = _least_split(model)
            for j in open_:
                if same[j] == same[i] and (j == i or all(a <= b <= c for a, b, c in zip(limits[i], limits[j], most))):
                    found[j] = metric
    delete_path(spark, path)
    return [(p, found[i]) for i, p in enumerate(grid)]

"""Linear least squares from sufficient statistics: gradient steps and cross-validation in one scan.

One aggregate adds up the products of features and label, per group if asked (a fold, a
user segment).  What follows works on these sums, whose size depends on the number of
features only: the gradient steps of the trainer are an ``aggregate`` over the step
numbers inside the same plan, errors are quadratic forms of the sums, and leaving a fold
out is a subtraction.  Decimal inputs are summed exactly, so results do not depend on
the partitioning.

Rows with a null in a feature or the label are left out.  No rows: weights stay 0, errors are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.operators.model import split_marker

#: The trainer's settings: steps, their size, and the relative change of the weights that ends them.
STEPS, STEP_SIZE, TOLERANCE = 100, 1e-8, 1e-3


def _names(d: int) -> list[str]:
    return ["n", *[f"x{i}_{j}" for i in range(d) for j in range(i, d)], *[f"xy{i}" for i in range(d)], "yy"]


def moments(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """``by``, then ``n``, ``x{i}_{j}`` (i <= j), ``xy{i}`` and ``yy``: map-side combined sums in the input types."""
    x, y = [F.col(f) for f in features], F.col(label)
    full = y.isNotNull()
    for c in x:
        full = full & c.isNotNull()
    sums = [F.sum(x[i] * x[j]).alias(f"x{i}_{j}") for i in range(len(x)) for j in range(i, len(x))]
    sums += [F.sum(c * y).alias(f"xy{i}") for i, c in enumerate(x)] + [F.sum(y * y).alias("yy")]
    return df.where(full).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sums)


def _at(i: int, j: int) -> str:
    return f"x{min(i, j)}_{max(i, j)}"


def _plus(terms: list[str]) -> str:
    out = terms[0]
    for t in terms[1:]:
        out = f"({out} + {t})"
    return out


def gradient_steps(sums: DataFrame, d: int, steps: int = STEPS, step_size: float = STEP_SIZE, tolerance: float = TOLERANCE) -> DataFrame:
    """L2: full-batch gradient descent from zero weights, step ``step_size / sqrt(t)``, at most ``steps`` of them.

    Ends early when the weights move by less than ``tolerance`` times their norm (1 at least), from the
    second step on.  Adds ``weights`` (array) and ``steps``.  ``sums`` holds moments as doubles.
    """
    grads = [f"(({_plus([f'{_at(i, j)} * s.w[{j}]' for j in range(d)])} - xy{i}) / n)" for i in range(d)]
    moved = ", ".join(f"s.w[{i}] - {step_size!r}D / sqrt(cast(t AS double)) * {g}" for i, g in enumerate(grads))
    gap = "sqrt(" + _plus([f"(w[{i}] - s.w[{i}]) * (w[{i}] - s.w[{i}])" for i in range(d)]) + ")"
    norm = "sqrt(" + _plus([f"w[{i}] * w[{i}]" for i in range(d)]) + ")"
    # transform over a one-element array binds the new weights once.
    step = f"""element_at(transform(array(array({moved})), w -> named_struct('w', w, 'steps', t,
      'done', t > 1 AND {gap} < {tolerance!r}D * greatest({norm}, 1D))), 1)"""
    start = f"named_struct('w', array({', '.join(['0D'] * d)}), 'steps', 0, 'done', n = 0)"
    fit = F.expr(f"aggregate(sequence(1, {int(steps)}), {start}, (s, t) -> CASE WHEN s.done THEN s ELSE {step} END)")
    return sums.withColumn("_fit", fit).withColumn("weights", F.col("_fit.w")).withColumn("steps", F.col("_fit.steps")).drop("_fit")


def squared_error_sql(d: int, weights: str = "weights", prefix: str = "") -> str:
    """Sum of squared errors of the given weights, as a quadratic form of the moments."""
    fit = _plus([f"{weights}[{i}] * {prefix}xy{i}" for i in range(d)])
    square = _plus([f"{weights}[{i}] * ({_plus([f'{prefix}{_at(i, j)} * {weights}[{j}]' for j in range(d)])})" for i in range(d)])
    return f"greatest({prefix}yy - 2D * {fit} + {square}, 0D)"


def as_doubles(sums: DataFrame, d: int) -> DataFrame:
    return sums.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _names(d) if c != "n"})


def fit_steps(df: DataFrame, features: Sequence[str], label: str, **settings) -> DataFrame:
    """L2 in one row: ``n, steps, weights, rmse_zero, rmse_model`` on the rows it was fitted to; one scan, no driver loop."""
    d = len(features)
    fit = gradient_steps(as_doubles(moments(df, features, label), d), d, **settings)
    return fit.select("n", "steps", "weights", F.expr("sqrt(yy / nullif(n, 0))").alias("rmse_zero"),
                      F.expr(f"sqrt({squared_error_sql(d)} / nullif(n, 0))").alias("rmse_model"))


def fold_of(key: str, folds: int, buckets: int = 1000):
    """L1: the fold of a key, from its SHA-1 bucket; folds are disjoint and complete."""
    return F.floor(split_marker(key, buckets)[0] * folds / buckets).cast("int")


def cross_validate(df: DataFrame, key: str, features: Sequence[str], label: str, folds: int = 10, **settings) -> DataFrame:
    """L1 + L2 + L3 + A13 for every fold: fitted on all others, scored on the fold itself; one scan of ``df``.

    Output: ``fold, n_train, n_valid, steps, weights, rmse_zero, rmse_model`` for each fold that holds rows.
    """
    d = len(features)
    per_fold = moments(df.withColumn("_fold", fold_of(key, folds)), features, label, ["_fold"])
    whole = Window.partitionBy(F.lit(1))  # at most one row per fold
    both = per_fold.select("_fold", *[F.col(c).alias(f"v_{c}") for c in _names(d)], *[(F.sum(c).over(whole) - F.col(c)).alias(c) for c in _names(d)])
    both = as_doubles(both, d).withColumns({f"v_{c}": F.coalesce(F.col(f"v_{c}").cast("double"), F.lit(0.0)) for c in _names(d) if c != "n"})
    fit = gradient_steps(both, d, **settings)
    return fit.select(F.col("_fold").alias("fold"), F.col("n").alias("n_train"), F.col("v_n").alias("n_valid"), "steps", "weights",
                      F.expr("sqrt(v_yy / v_n)").alias("rmse_zero"), F.expr(f"sqrt({squared_error_sql(d, prefix='v_')} / v_n)").alias("rmse_model"))

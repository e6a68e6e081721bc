"""Second-order boosted regression trees for a whole parameter grid at once (L4).

All configurations grow their trees together, level by level.  A level is one Spark
job: every task walks its rows down the trees so far and adds up gradients and
hessians per (tree, node, feature, bin); Spark sums these cells, turns them
into running sums over the bins and keeps the best split of each node.  The driver
holds the trees and never sees rows or histograms.

* Bins are shared by all configurations: quantile cuts per feature, taken once.  A
  null or NaN value goes to the lowest bin.
* Split score: ``GL^2/(HL+l) + GR^2/(HR+l) - G^2/(H+l)`` with ``l = reg_lambda``.  A node
  splits if the best score is positive and both sides hold a hessian sum of at least
  ``min_child_weight``.  Then, bottom up, a split over two leaves whose score is less
  than ``gamma`` is taken back.  A leaf adds ``-eta * G / (H + l)`` to the prediction.
* Equal scores: the lowest feature, then the lowest bin.  Scores are compared in
  single precision, so that the order in which sums are added does not decide.
* Objectives: squared error (hessian 1 a row) and logistic (labels 0 and 1).
* Configurations are worked out apart only where they differ: those with the same
  predictions so far are one column of the table, those whose trees are equal up to a
  level share its histograms.  Trees are compared exactly, so nothing is assumed of the
  rows; in the worst case every configuration has its own column and histograms.

Predictions of a round are written to the shared checkpoint folder next to the binned
rows, so a lost executor costs one level, and the previous round's table is deleted.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from featloom.session import delete_path, scratch_path

#: The tuning grid (step size, split penalty, least hessian of a child, depth).
GRID = {"eta": (0.01, 0.1, 0.5, 1.0), "gamma": (0.01, 0.1, 0.5, 1.0), "min_child_weight": (0.1, 0.5, 1.0, 5.0), "max_depth": (3, 6)}
CELL = "config long, node long, feature long, bin long, g double, h double"
SLOTS = 2**19  # rows x trees walked at a time: numbers in memory


@dataclass(frozen=True)
class Config:
    eta: float = 0.3
    gamma: float = 0.0
    min_child_weight: float = 1.0
    max_depth: int = 6


@dataclass
class Tree:
    """Nodes by heap number: children of i are 2i+1 and 2i+2; feature -1 is a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    score: np.ndarray
    grad: np.ndarray
    hess: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.zeros(n))

    def shape(self, nodes: int | None = None) -> tuple[bytes, bytes]:
        """Its splits (those of the first ``nodes`` nodes), for comparison."""
        return self.feature[:nodes].tobytes(), self.cut[:nodes].tobytes()

    def copy(self) -> Tree:
        return Tree(*[a.copy() for a in (self.feature, self.cut, self.score, self.grad, self.hess)])

    def prune(self, gamma: float) -> None:
        """Takes back splits over two leaves that score less than ``gamma``, from the bottom up."""
        for i in range((len(self.feature) - 1) // 2 - 1, -1, -1):
            if self.feature[i] >= 0 and self.feature[2 * i + 1] < 0 and self.feature[2 * i + 2] < 0 and self.score[i] < gamma:
                self.feature[i] = -1

    def take(self, r) -> None:
        """Sums of a node and, with its split, of its children."""
        i = r.node
        self.grad[i], self.hess[i] = r.g, r.h
        if r.choices:
            self.feature[i], self.cut[i], self.score[i] = r.split.feature, r.split.bin, r.split.score
            self.grad[2 * i + 1:2 * i + 3] = r.split.gl, r.g - r.split.gl
            self.hess[2 * i + 1:2 * i + 3] = r.split.hl, r.h - r.split.hl

    def leaf_values(self, eta: float, reg_lambda: float) -> np.ndarray:
        return -eta * self.grad / (self.hess + reg_lambda)


@dataclass
class Forest:
    """The trees of every configuration, and what is needed to score rows with them."""

    configs: list[Config]
    features: list[str]
    cuts: list[list[float]]
    base: float
    reg_lambda: float
    objective: str
    rounds: list[list[Tree]] = field(default_factory=list)


def grid(**lists: Sequence[float]) -> list[Config]:
    """All combinations of the given lists; without any, the whole ``GRID``."""
    lists = lists or GRID
    return [Config(**dict(zip(lists, values))) for values in itertools.product(*lists.values())]


def quantile_cuts(df: DataFrame, features: Sequence[str], bins: int) -> list[list[float]]:
    """Rising distinct cuts per feature (at most ``bins - 1``); a value goes to the bin of the cuts below it."""
    at = [i / bins for i in range(1, bins)]
    value = [F.nanvl(F.col(f).cast("double"), F.lit(None)) for f in features]
    row = df.agg(*[F.percentile_approx(v, at, 10_000).alias(f"c{i}") for i, v in enumerate(value)]).first()
    return [sorted(set(row[i] or [])) for i in range(len(features))]


def _columns(b: pa.RecordBatch, name: str, width: int, dtype) -> np.ndarray:
    flat = b.column(b.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(b.num_rows, width)


def _walk(bins: np.ndarray, trees: list[Tree], levels: int) -> np.ndarray:
    """Heap number of the node each row has reached in each tree after at most ``levels`` steps."""
    rows, n = np.arange(len(bins))[:, None], np.arange(len(trees))[None, :]
    size = max(len(t.feature) for t in trees)
    feature, cut = np.full((len(trees), size), -1), np.zeros((len(trees), size), np.int64)
    for c, t in enumerate(trees):
        feature[c, :len(t.feature)], cut[c, :len(t.cut)] = t.feature, t.cut
    node = np.zeros((len(bins), len(trees)), np.int64)
    for _ in range(levels):
        f = feature[n, node]
        right = bins[rows, np.maximum(f, 0)] > cut[n, node]
        node = np.where(f >= 0, 2 * node + 1 + right, node)
    return node


def _derivatives(pred: np.ndarray, label: np.ndarray, objective: str) -> tuple[np.ndarray, np.ndarray]:
    if objective == "logistic":
        p = 1 / (1 + np.exp(-pred))
        return p - label[:, None], p * (1 - p)
    return pred - label[:, None], np.ones_like(pred)


def _slices(b: pa.RecordBatch, trees: int) -> Iterator[pa.RecordBatch]:
    step = max(1, SLOTS // max(trees, 1))
    return (b.slice(at, step) for at in range(0, b.num_rows, step))


def _cells(trees: list[Tree], columns: list[int], level: int, width: int, sizes: list[int], objective: str):
    """Gradient and hessian sums of a task's training rows for the nodes of one level, each tree after its column of predictions."""
    first, nodes, most = 2**level - 1, 2**level, max(sizes)
    used, of = np.unique(columns, return_inverse=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, len(trees) * nodes * width * most))
        for whole in batches:
            for b in _slices(whole, len(trees)):
                bins, label = _columns(b, "bins", width, np.int64), b.column(b.schema.get_field_index("label")).to_numpy()
                pred = _columns(b, "pred", -1, float)[:, used]
                grad, hess = _derivatives(pred, label, objective)
                node = _walk(bins, trees, level)
                row, tree = np.nonzero(node >= first)
                slot = (tree * nodes + node[row, tree] - first) * width
                g, h = grad[row, of[tree]], hess[row, of[tree]]
                for f in range(width):
                    key = (slot + f) * most + bins[row, f]
                    total[0] += np.bincount(key, g, total.shape[1])
                    total[1] += np.bincount(key, h, total.shape[1])
        cell = np.flatnonzero(total[1])
        slot, f = np.divmod(cell // most, width)
        yield pa.RecordBatch.from_arrays([pa.array(slot // nodes), pa.array(slot % nodes + first), pa.array(f), pa.array(cell % most), pa.array(total[0][cell]), pa.array(total[1][cell])],
                                         names=["config", "node", "feature", "bin", "g", "h"])

    return run


def _score(g: str, h: str) -> str:
    return f"{g} * {g} / ({h} + reg_lambda)"


def best_splits(cells: DataFrame, configs: DataFrame, reg_lambda: float) -> DataFrame:
    """One row per (config, least, node): its sums, and its best allowed split (feature null: none).

    ``configs`` has a row for each least hessian sum asked for of a config's cells.  One
    exchange by (config, node) serves the sums, the running sums over bins and the choice.
    """
    keys = ["config", "node"]
    sums = cells.repartition(*keys).groupBy(*keys, "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    whole = Window.partitionBy(*keys, "feature")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = sums.select(*keys, "feature", "bin", F.sum("g").over(upto).alias("gl"), F.sum("h").over(upto).alias("hl"),
                       F.sum("g").over(whole).alias("gt"), F.sum("h").over(whole).alias("ht"), F.lead("bin").over(whole.orderBy("bin")).alias("next"))
    runs = runs.join(F.broadcast(configs), "config").withColumn("reg_lambda", F.lit(reg_lambda))  # at most one row per configuration
    score = F.expr(f"{_score('gl', 'hl')} + {_score('(gt - gl)', '(ht - hl)')} - {_score('gt', 'ht')}")
    allowed = F.col("next").isNotNull() & (F.col("hl") >= F.col("least")) & (F.col("ht") - F.col("hl") >= F.col("least")) & (score > 1e-6)
    # Highest score, then lowest feature and bin; single precision, so that the order of additions does not decide.
    order = F.struct(score.cast("float"), -F.col("feature"), -F.col("bin"))
    return runs.groupBy("config", "least", "node").agg(
        F.min_by("gt", "feature").alias("g"), F.min_by("ht", "feature").alias("h"), F.count(F.when(allowed, 1)).alias("choices"),
        F.max_by(F.struct("feature", "bin", "gl", "hl", score.alias("score")), F.when(allowed, order)).alias("split"))


class _Stage:
    """The one table of a fit under the shared folder: each version is deleted once the next one is written."""

    def __init__(self, spark) -> None:
        self.spark, self.path = spark, None

    def put(self, df: DataFrame) -> DataFrame:
        old, self.path = self.path, scratch_path(self.spark, "boosting")
        df.write.option("compression", "zstd").parquet(self.path)
        if old:
            delete_path(self.spark, old)
        return self.spark.read.schema(df.schema).parquet(self.path)


def _binned(rows: DataFrame, names: Sequence[str], forest: Forest) -> DataFrame:
    """Adds the bin of each feature and the starting prediction of each configuration."""
    bins = []
    for name, cuts in zip(names, forest.cuts):
        v = F.nanvl(F.col(name).cast("double"), F.lit(None))
        below = [F.when(v > c, 1).otherwise(0) for c in cuts]
        bins.append(sum(below, F.lit(0)))
    return rows.withColumn("bins", F.array(*bins)).withColumn("pred", F.array(F.lit(float(forest.base))))


@dataclass
class _Round:
    """What a round adds: column j of the new predictions is column ``parent[j]`` of the old ones and a tree's leaf values."""

    trees: list[Tree]
    values: list[np.ndarray]
    parent: list[int]
    of: list[int]  # the new column of each configuration

    @staticmethod
    def of_trees(trees: list[Tree], configs: list[Config], reg_lambda: float, of: list[int]) -> _Round:
        """``trees``: one per configuration; ``of``: the old column of each.  Equal columns with equal trees and leaf values are one."""
        out, seen = _Round([], [], [], []), {}
        for t, c, old in zip(trees, configs, of):
            v = t.leaf_values(c.eta, reg_lambda)
            key = (old, *t.shape(), v.tobytes())
            if key not in seen:
                seen[key] = len(out.trees)
                out.trees.append(t)
                out.values.append(v)
                out.parent.append(old)
            out.of.append(seen[key])
        return out


def _added(new: _Round, width: int):
    """Predictions after one more round."""
    depth = max(int(np.log2(len(t.feature) + 1)) - 1 for t in new.trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, len(new.trees)):
                i = b.schema.get_field_index("pred")
                node, pred = _walk(_columns(b, "bins", width, np.int64), new.trees, depth), _columns(b, "pred", -1, float)[:, new.parent]
                pred = pred + np.stack([v[node[:, c]] for c, v in enumerate(new.values)], 1)
                yield b.set_column(i, b.schema.field(i), pa.array(list(pred), b.schema.field(i).type))

    return run


def _grown(state: DataFrame, configs: list[Config], of: list[int], leasts: list[float], width: int, sizes: list[int], objective: str, reg_lambda: float) -> list[Tree]:
    """One tree per configuration, not pruned: a Spark job a level over the trees that differ up to there."""
    trees = {k: Tree.empty(k[2]) for k in zip(of, leasts, (c.max_depth for c in configs))}
    for level in range(max(c.max_depth for c in configs)):
        shared: dict = {}
        for k, t in trees.items():
            if k[2] > level:
                shared.setdefault((k[0], *t.shape(2**level - 1)), []).append(k)
        kinds = list(shared.values())
        cells = state.where("train").mapInArrow(_cells([trees[m[0]] for m in kinds], [m[0][0] for m in kinds], level, width, sizes, objective), CELL)
        least = sorted({(i, k[1]) for i, m in enumerate(kinds) for k in m})
        found = best_splits(cells, state.sparkSession.createDataFrame(least, "config long, least double"), reg_lambda).collect()  # at most one row per open node
        for r in found:
            for k in kinds[r.config]:
                if k[1] == r.least:
                    trees[k].take(r)
        if not any(r.choices for r in found):
            break
    return [trees[k] for k in zip(of, leasts, (c.max_depth for c in configs))]


def fit_grid(df: DataFrame, features: Sequence[str], label: str, configs: Sequence[Config] | None = None, train: str | None = None,
             rounds: int = 10, bins: int = 32, reg_lambda: float = 1.0, base: float = 0.5, objective: str = "squared") -> tuple[Forest, DataFrame]:
    """Fits every configuration on the rows where the boolean column ``train`` holds (all without one).

    Returns the trees and a table of all rows with a label: ``label, train, pred`` (an array, one
    prediction per configuration).  A row without a label, or an empty table, is left out.
    """
    spark, configs, features = df.sparkSession, list(configs or grid()), list(features)
    rows = df.select(*[F.col(f).cast("double").alias(f"f{i}") for i, f in enumerate(features)], F.col(label).cast("double").alias("label"),
                     (F.lit(True) if train is None else F.coalesce(F.col(train), F.lit(False))).alias("train")).where("label IS NOT NULL")
    names, width = [f"f{i}" for i in range(len(features))], len(features)
    stage = _Stage(spark)
    forest = Forest(configs, features, quantile_cuts(rows.where("train"), names, bins), base, reg_lambda, objective)
    state = stage.put(_binned(rows, names, forest).select("label", "train", "bins", "pred"))
    sizes, of = [len(c) + 1 for c in forest.cuts], [0] * len(configs)
    # Hessian sums of squared errors are whole numbers: what they must reach can be rounded up.
    leasts = [float(np.ceil(c.min_child_weight) if objective == "squared" else c.min_child_weight) for c in configs]
    for _ in range(rounds):
        trees = [t.copy() for t in _grown(state, configs, of, leasts, width, sizes, objective, reg_lambda)]
        for t, c in zip(trees, configs):
            t.prune(c.gamma)
        forest.rounds.append(trees)
        new = _Round.of_trees(trees, configs, reg_lambda, of)
        state, of = stage.put(state.mapInArrow(_added(new, width), state.schema)), new.of
    return forest, state.select("label", "train", F.array(*[F.col("pred")[i] for i in of]).alias("pred"))


def predict(df: DataFrame, forest: Forest) -> DataFrame:
    """Adds ``pred``: the raw prediction of every configuration for each row (one pass over all rounds)."""
    names, schema, width = [f"f{i}" for i in range(len(forest.features))], df.schema, len(forest.features)
    rows = _binned(df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), *[F.col(f).cast("double").alias(n) for f, n in zip(forest.features, names)]),
                   names, forest).select("row", "bins", "pred")
    of = [0] * len(forest.configs)
    for trees in forest.rounds:
        new = _Round.of_trees(trees, forest.configs, forest.reg_lambda, of)
        rows, of = rows.mapInArrow(_added(new, width), rows.schema), new.of
    return rows.select(*[F.col("row").getField(f.name).alias(f.name) for f in schema], F.array(*[F.col("pred")[i] for i in of]).alias("pred"))


def grid_rmse(configs: Sequence[Config], scored: DataFrame) -> DataFrame:
    """A13 for each configuration: ``eta, gamma, min_child_weight, max_depth, n, rmse, n_train, rmse_train``."""
    each = scored.select("train", "label", F.posexplode("pred").alias("config", "p")).withColumn("se", F.pow(F.col("p") - F.col("label"), 2))
    side = {"": ~F.col("train"), "_train": F.col("train")}
    found = each.groupBy("config").agg(*[c for s, on in side.items() for c in (F.count(F.when(on, 1)).alias(f"n{s}"), F.sqrt(F.avg(F.when(on, F.col("se")))).alias(f"rmse{s}"))])
    names = scored.sparkSession.createDataFrame([(i, float(c.eta), float(c.gamma), float(c.min_child_weight), c.max_depth) for i, c in enumerate(configs)],
                                                "config int, eta double, gamma double, min_child_weight double, max_depth int")
    return names.join(found, "config", "left").drop("config")

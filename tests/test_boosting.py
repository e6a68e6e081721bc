"""Boosted trees against a plain recursive version."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from featloom.operators import boosting as gb


def plain(x, y, cuts, c, rounds, lam=1.0, base=0.5, logistic=False):
    """Grows, prunes and applies one tree after another, on whole arrays."""
    bins = np.stack([np.searchsorted(k, np.where(np.isnan(v), -np.inf, v), side="left") for k, v in zip(cuts, x.T)], 1)
    pred = np.full(len(y), base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-pred))
        g, h = (p - y, p * (1 - p)) if logistic else (pred - y, np.ones(len(y)))

        def grow(rows, depth):
            gt, ht = g[rows].sum(), h[rows].sum()
            best = None
            for f in range(bins.shape[1]) if depth < c.max_depth else ():
                for cut in sorted(set(bins[rows, f]))[:-1]:
                    left = rows[bins[rows, f] <= cut]
                    gl, hl = g[left].sum(), h[left].sum()
                    score = gl**2 / (hl + lam) + (gt - gl)**2 / (ht - hl + lam) - gt**2 / (ht + lam)
                    if hl >= c.min_child_weight and ht - hl >= c.min_child_weight and score > 1e-6:
                        key = (np.float32(score), -f, -cut)
                        best = max(best, key) if best else key
            leaf = [(rows, -c.eta * gt / (ht + lam))]
            if not best:
                return leaf
            go = bins[rows, -best[1]] <= -best[2]
            low, high = grow(rows[go], depth + 1), grow(rows[~go], depth + 1)
            return leaf if len(low) == len(high) == 1 and best[0] < c.gamma else low + high

        for rows, v in grow(np.arange(len(y)), 0):
            pred[rows] += v
    return pred


@pytest.fixture(scope="module")
def data(spark):
    rnd = np.random.default_rng(4)
    x = np.round(rnd.standard_normal((300, 3)), 1)
    x[rnd.random(300) < 0.1, 2] = np.nan
    y = np.where(x[:, 0] > 0, 3.0, -1.0) * np.where(x[:, 1] > 0.5, 2.0, 1.0) + np.nan_to_num(x[:, 2]) + rnd.standard_normal(300) * 0.1
    rows = [(i, *map(float, v), float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(4)
    return x, y, df


@pytest.mark.parametrize("objective", ["squared", "logistic"])
def test_equals_plain_trees(data, objective):
    x, y, df = data
    logistic = objective == "logistic"
    if logistic:
        y, df = (y > 1).astype(float), df.withColumn("y", (F.col("y") > 1).cast("double"))
    configs = [gb.Config(*c) for c in itertools.product((0.3, 1.0), (0.0, 30.0 if not logistic else 2.0), (0.1, 5.0), (1, 4))]
    forest, scored = gb.fit_grid(df, ["a", "b", "c"], "y", configs, rounds=3, bins=8, objective=objective)
    got = {r.id: r.pred for r in gb.predict(df, forest).collect()}
    for i, c in enumerate(configs):
        want = plain(x, y, forest.cuts, c, 3, logistic=logistic)
        assert [got[k][i] for k in range(len(y))] == pytest.approx(list(want), abs=1e-9), c
    # The table of the fit holds the same predictions.
    assert sorted(r.pred[0] for r in scored.collect()) == pytest.approx(sorted(p[0] for p in got.values()))


def test_whole_grid_has_128_and_one_job_per_level(spark, data, monkeypatch):
    _, _, df = data
    assert len(gb.grid()) == 128 == len(set(gb.grid()))
    calls, real = [], gb.best_splits
    monkeypatch.setattr(gb, "best_splits", lambda *a: calls.append(1) or real(*a))
    _, scored = gb.fit_grid(df.withColumn("t", F.col("id") % 10 < 9), ["a", "b", "c"], "y", train="t", rounds=2, bins=8)
    assert len(calls) <= 2 * 6
    out = gb.grid_rmse(gb.grid(), scored).collect()
    assert len({(r.eta, r.gamma, r.min_child_weight, r.max_depth) for r in out}) == 128
    assert {(r.n, r.n_train) for r in out} == {(30, 270)} and all(r.rmse >= 0 for r in out)


def test_one_exchange_for_a_level(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cells = spark.createDataFrame([(0, 0, 0, 0, 1.0, 1.0)], gb.CELL)
        least = spark.createDataFrame([(0, 1.0)], "config long, least double")
        plan = gb.best_splits(cells, least, 1.0)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1


def test_edge_tables(spark):
    schema = "a double, b double, y double, bins string, pred string, label string"
    none = spark.createDataFrame([], schema)
    forest, scored = gb.fit_grid(none, ["a", "b"], "y", [gb.Config()], rounds=2)
    assert scored.count() == 0 and forest.cuts == [[], []]
    odd = spark.createDataFrame([(None, float("nan"), 1.0, "x", "x", "x"), (1.0, 2.0, None, "x", "x", "x"), (None, None, 1.0, "x", "x", "x")], schema)
    forest, scored = gb.fit_grid(odd, ["a", "b"], "y", [gb.Config(eta=1.0, max_depth=2)], rounds=1)
    assert [r.pred for r in scored.collect()] == [[pytest.approx(0.5 + 1.0 / 3)]] * 2
    kept = gb.predict(odd, forest)
    assert kept.columns[:3] == ["a", "b", "y"] and kept.count() == 3


def test_configurations_are_apart_only_where_they_differ(spark, data, monkeypatch):
    x, y, df = data
    grown, added, cells, rounds = [], [], gb._cells, gb._added
    monkeypatch.setattr(gb, "_cells", lambda trees, *a: grown.append(len(trees)) or cells(trees, *a))
    monkeypatch.setattr(gb, "_added", lambda new, *a: added.append(len(new.trees)) or rounds(new, *a))
    configs = [gb.Config(*c) for c in itertools.product((0.3, 1.0), (0.0, 0.5, 30.0), (0.2, 1.0, 8.0), (1, 4))]
    forest, scored = gb.fit_grid(df, ["a", "b", "c"], "y", configs, rounds=3, bins=8)
    assert grown[0] == 1 and max(grown + added) < len(configs)
    got = sorted((r.label, r.pred) for r in scored.collect())
    assert len(got) == len(y) and {len(p) for _, p in got} == {len(configs)}
    for i, c in enumerate(configs):
        want = sorted(zip(y, plain(x, y, forest.cuts, c, 3)))
        assert [p[i] for _, p in got] == pytest.approx([float(p) for _, p in want], abs=1e-9), c

"""Whitening against numpy's eigensolver, and its parts."""

import numpy as np
import pytest

from featloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, v string, component string, n string, d string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "x", "x", "x", "x") for i, v in vectors], SCHEMA)


def brute(vectors, wanted=wh.COMPONENTS):
    rows = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(0)
    far = ((n * x - s) ** 2).sum(1)
    y = ((n * x - s) / n).astype(float)
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:wanted], u[:, ::-1][:, :wanted]
    keep = e > 1e-10 * e[0]
    return [i for i, _ in rows], n, far, y @ (u[:, keep] / np.sqrt(e[keep])), e[keep] / np.trace(cov)


@pytest.fixture(scope="module")
def vectors():
    rnd = np.random.default_rng(3)
    spread = np.linspace(0.05, 2, 40)
    out = [(int(i), [float(np.float32(c)) for c in rnd.standard_normal(40) * spread]) for i in range(400)]
    odd = [(900, None), (901, [None] * 40), (902, [float("nan")] + [0.0] * 39), (903, [float("inf")] + [0.0] * 39), (904, []), (905, [1.0, 2.0]), (5, out[5][1]), (None, out[6][1])]
    return out, odd


def test_equals_direct_eigenvectors(spark, vectors):
    out, odd = vectors
    got = wh.whiten(frame(spark, out + odd).repartition(5)).collect()
    ids, n, far, white, share = brute(out + odd[-2:])
    k = len(share)
    assert k == 32 and len(got) == n * k and {r.n for r in got} == {n}
    assert got[0].identity_error < 1e-9
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(ids) and len(by[5]) == 2 * k
    sign = {}
    for i, f, w in zip(ids, far, white):
        for r in by[i]:
            c = r.component - 1
            assert int(r.deviation) == f and r.explained == pytest.approx(share[c], rel=1e-9)
            sign.setdefault(c, np.sign(r.whitened * w[c]))
            assert r.whitened * sign[c] == pytest.approx(w[c], abs=1e-8)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.5, 0.25])], [(i, [0.5, 0.25]) for i in range(9)]])
def test_nothing_to_whiten(spark, rows):
    out = wh.whiten(frame(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert out.count() == 0


def test_lesser_rank(spark):
    rnd = np.random.default_rng(1)
    base = rnd.standard_normal((3, 12))
    got = wh.whiten(frame(spark, [(i, [float(c) for c in rnd.integers(-8, 8, 3) @ np.round(base * 64) / 64]) for i in range(60)])).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**30 + i * 2**20), float(-i)]) for i in range(50)]
    _, n, far, _, _ = brute(rows)
    got = {r.vec_id: int(r.deviation) for r in wh.whiten(frame(spark, rows)).collect()}
    assert got == {i: int(f) for i, f in enumerate(far)} and max(got.values()) > 2**62


@pytest.mark.parametrize("values", [np.arange(1.0, 65), np.repeat([5.0, 4.0, 1.0], [20, 20, 24]), 2.0 ** -np.arange(40), np.r_[np.ones(31), 1 - 1e-13 * np.arange(33)],
                                    np.r_[np.linspace(1, 2, 33), np.zeros(31)]])
def test_spectra(spark, values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    v = q @ np.diag(values) @ q.T
    v = (v + v.T) / 2
    t = wh.tridiagonal(v)
    for s in (0.3, 0.77, 1.5, 4.5, 33.3):
        assert wh.count_above(t, s) == int((values > s).sum())
    e, u = wh.components(spark, v, 32)
    top = np.sort(values)[::-1][:32]
    assert np.allclose(e, top, rtol=0, atol=1e-12 * top[0])
    assert np.abs(u.T @ u - np.eye(len(e))).max() < 1e-12 and np.linalg.norm(v @ u - u * e, axis=0).max() < 1e-11 * top[0]


def test_a_missed_pair_is_an_error():
    with pytest.raises(ArithmeticError):
        wh.feast(np.diag([1.0, 2.0, 3.0]), 0.5, 1.5, 2, rounds=2)

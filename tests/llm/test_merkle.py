"""The manifest against a tree built in one go."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from featloom.llm import merkle as mk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos string, tree string, digest string, top string, part string, block string, tie string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA)


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    """Root and, for each node, its steps (left, right)."""
    steps, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for i, a in enumerate(at):
            f = a - a % 3
            steps[i].append(("".join(level[f:a]), "".join(level[a + 1:f + 3])))
            at[i] = a // 3
        level = [h("".join(level[i:i + 3])) for i in range(0, len(level), 3)]
    return level[0], steps


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = climb([leaf(*r) for r in by[s]])
    root, upper = climb([trees[s][0] for s in sources]) if sources else (None, [])
    for s, high in zip(sources, upper):
        for r, low in zip(by[s], trees[s][1]):
            steps = low + high
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            f = leaf(r[0], r[1].replace("\n", ""), *r[2:]) if tampered else leaf(*r)
            for left, right in steps:
                f = h(left + f + right)
            out.append((r[0], leaf(*r), trees[s][0], root, h("".join(a + b for a, b in steps)), f, f == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(2)
    hot = [(i, f"text {i}" + "\nmore" * rnd.randint(0, 2), "en", "hot", i) for i in rnd.sample(range(10**6), 260)]
    rest = [(i, rnd.choice([None, "", "é\nß", "\n"]), None, rnd.choice([None, "", "a", "b", "ß", "Z" * 50]), None) for i in range(-30, 30)]
    lone = [(9000 + i, "alone\n", "x", f"s{i}", 1) for i in range(11)]
    return hot + rest + lone + [hot[0]] * 2 + rest[:2] + [(None, "no id\n", "en", "hot", None), (None, None, None, None, None)]


@pytest.mark.parametrize("height", [1, 2, 7])
def test_equals_a_tree_built_in_one_go(spark, rows, height, monkeypatch):
    monkeypatch.setattr(mk, "HEIGHT", height)  # of blocks: 1 and 2 give trees of several epochs
    if height < 7:
        monkeypatch.setattr(mk, "_rise", _with_height(mk._rise, height))
        monkeypatch.setattr(mk, "_sink", _with_height(mk._sink, height))
    got = sorted(map(tuple, mk.audit(frame(spark, rows).repartition(6)).collect()), key=repr)
    assert got == brute(rows)


def _with_height(f, height):
    def run(batches):
        from featloom.llm import merkle

        merkle.HEIGHT, old = height, merkle.HEIGHT  # in the task's own process
        try:
            yield from f(batches)
        finally:
            merkle.HEIGHT = old

    return run


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 9, 10, 27, 28])
def test_small_sources(spark, n):
    rows = [(i, "a\nb", "en", "s", 3) for i in range(n)]
    assert sorted(map(tuple, mk.audit(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_a_proof_shows_any_change(spark, rows):
    docs = frame(spark, [r for r in rows if r[0] is not None])
    kept = mk.manifest(mk.leaves(docs))
    assert mk.fold(kept).where("folded_root <> root").count() == 0
    other = kept.withColumn("other", F.sha2(F.concat("digest", F.lit("!")), 256))
    assert mk.fold(other, "other").where("folded_root = root").count() == 0

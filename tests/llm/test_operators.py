"""Every operator against brute force on a small corpus with the awkward cases, and on empty tables."""

import collections
import gzip
import hashlib
import itertools
import os
import random
import re
import tracemalloc
import types
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from featloom.llm import chat, common, decontam, line_dedup, near_dup, packing, quality, secrets, suffix_dedup, url_filter, warc
from featloom.llm.catalog import RANKS
from featloom.llm.common import ASCII_SPACE

from .conftest import TR

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode() if isinstance(s, str) else s).hexdigest()


def bag(rows):
    return sorted(rows, key=repr)


def test_decontamination(spark, docs, corpus, empty):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    base = corpus[0][1]
    items = [(1, base[100:400].upper()), (2, "ab ab"), (3, None), (4, "unseen words only here"), (1, base[100:400].upper()), (None, "x")]
    windows = collections.defaultdict(set)
    for i, t in items:
        w = word.findall((t or "").translate(TR))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k:k + n])].add("null" if i is None else str(i))
    want = []
    for i, t in corpus:
        w, hit, found = word.findall((t or "").translate(TR)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k:k + n])):
                    found |= ids
                    hit.update(range(k, k + n))
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontam.decontaminate(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert bag(map(tuple, out.collect())) == bag(want)
    for bound in (1, 40):  # every item a group of its own; a few groups
        groups = decontam.decontaminate(docs, bench, max_terms=bound).select(*out.columns)
        assert len(list(decontam.item_groups(bench, bound))) > 1 and bag(map(tuple, groups.collect())) == bag(want)
    assert decontam.decontaminate(empty, bench).count() == 0
    assert {r.n_hit for r in decontam.decontaminate(docs, bench.where("false")).collect()} == {0}


def test_proximity(spark):
    item = " ".join(f"w{i}" for i in range(13))
    near = item.replace("w5 ", "w5 extra ")
    d = spark.createDataFrame([(1, near), (2, item), (3, "w0 " + "z " * 40 + "w12")], "doc_id long, text string")
    b = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r.doc_id: (r.n_items, r.n_near_items) for r in decontam.decontaminate(d, b).collect()}
    assert got == {1: (0, 1), 2: (1, 1), 3: (0, 0)}


def test_repeated_substrings(docs, corpus, empty):
    order = sorted(range(len(corpus)), key=lambda k: (corpus[k][0] is None, corpus[k][0] or 0, corpus[k][1] or ""))
    seen, want = set(), []
    for k in order:
        raw = (corpus[k][1] or "").encode()
        gone = bytearray(len(raw))
        for x in range(len(raw) - 99):
            s = raw[x:x + 100]
            if s in seen:
                gone[x:x + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        want.append((corpus[k][0], len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(kept)))
    assert bag(map(tuple, suffix_dedup.remove_repeats(docs).drop("kept").collect())) == bag(want)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_packing(docs, corpus, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, RANKS, public_tokenizers.PATTERN).collect()
    sequences, pieces = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32
    for v in sequences.values():
        ends = np.cumsum([0, *(n for _, n in sorted(v))])
        assert [o for o, _ in sorted(v)] == list(ends[:-1]) and ends[-1] <= 1024
    for i, t in corpus:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        mine = [r for r in pieces[i] if r.doc_tokens == len(ids)]
        copies = sum(a == i for a, _ in corpus)
        assert sum(r.length for r in mine) == copies * len(ids)
        assert all(r.ids == ids[r.start:r.start + r.length].tobytes() for r in mine)
    assert packing.pack(empty, RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing_scores_whole_documents_by_all_terms():
    rnd = np.random.default_rng(3)
    p = 1 / np.arange(1, 400)
    docs = [rnd.choice(np.arange(1, 400, dtype=np.uint16), rnd.integers(60, 3000), p=p / p.sum()) for _ in range(40)]
    df = np.bincount(np.concatenate([np.unique(x) for x in docs]), minlength=1 << 16)
    idf, mean = np.log1p((40 - df + 0.5) / (df + 0.5)), float(np.mean([len(x) for x in docs]))
    shard = packing.Shard(docs, np.array([len(x) % 1024 for x in docs]), idf, mean)
    for seed in range(40):
        want = np.zeros(40)
        for other, x in enumerate(docs):
            tf = collections.Counter(x.tolist())
            want[other] = sum(idf[t] * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t in np.unique(docs[seed]).tolist() if df[t] > 1)
        assert np.allclose(shard.scores(seed), want, rtol=1e-4)
        assert len(shard.neighbours(seed)) == sum(len(x) % 1024 > 0 for x in docs)


def test_packing_fills_windows_with_the_best_unused_neighbours():
    rnd = np.random.default_rng(5)
    docs = [rnd.choice(np.arange(1, 200, dtype=np.uint16), rnd.integers(20, 900)) for _ in range(30)]
    df = np.bincount(np.concatenate([np.unique(x) for x in docs]), minlength=1 << 16)
    idf, left = np.log1p((30 - df + 0.5) / (df + 0.5)), [len(x) for x in docs]
    shard = packing.Shard(docs, np.array(left), idf, float(np.mean(left)))
    want, seed = [], 0
    while any(left):
        seed = seed if left[seed] else next(i for i, n in enumerate(left) if n)
        score = shard.scores(seed)
        order = [seed, *sorted((i for i in range(30) if left[i] and i != seed), key=lambda i: (-score[i], i))]
        room, window = 1024, []
        for i in order:
            n = min(room, left[i])
            window.append((i, n))
            left[i], room = left[i] - n, room - n
            if left[i]:
                seed = i
            if not room:
                break
        want.append(window)
    assert list(shard.sequences()) == want


def test_packing_finds_neighbours_in_other_partitions(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TARGET", 20)
    monkeypatch.setattr(packing, "TOPICS", 10)
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    topic = [[word() for _ in range(30)] for _ in range(10)]
    rows = [(t * 100 + i, " ".join(rnd.choice(topic[t]) for _ in range(60))) for i in range(20) for t in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7, "doc_id")
    pieces = packing.pack(docs, RANKS, public_tokenizers.PATTERN).collect()
    together = collections.defaultdict(set)
    for r in pieces:
        together[r.sequence_id].add(r.doc_id)
    pairs = [a // 100 == b // 100 for v in together.values() for a, b in itertools.combinations(v, 2)]
    assert np.mean(pairs) > 0.7  # 0.1 where documents meet by chance
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_copies_of_one_document_are_dealt_over_shards():
    rnd = np.random.default_rng(9)
    flags = (rnd.random((3000, 64)) < 0.3).astype(np.float32)
    flags[::3] = flags[0]
    line = packing.Topics(flags[::2], np.ones(64, np.float32))
    shard = (line.place(flags, np.arange(3000) * 0.618 % 1) * 30).astype(int)
    sizes = np.bincount(shard, minlength=30)
    assert sizes.sum() == 3000 and sizes.max() < 250 and len(set(shard[::3])) >= 8
    near = flags[1::3].copy()
    near[:, 0] = 1 - near[:, 0]  # one term of 64 is another
    moved = np.abs(line.place(near, np.zeros(1000)) - line.place(flags[1::3], np.zeros(1000)))
    assert np.mean(moved < 1 / 30) > 0.5


def test_packing_neighbour_comes_from_the_body(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    body, tail = "river mountain valley forest ", "engine piston valve gear "
    n = lambda t: len(tok.encode(t, add_special_tokens=False).ids) + 1
    long = body * 100
    while n(long + tail) < 1024 + 3:
        long += body
    assert n(long + tail) < 1024 + 40
    rows = [(1, long + tail), (2, tail * 40), (3, tail * 40), (4, body * 40), (5, tail * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    pieces = packing.pack(docs, RANKS, public_tokenizers.PATTERN).collect()
    of_seed = next(r.sequence_id for r in pieces if r.doc_id == 1 and r.start == 1024)
    first = sorted((r.offset, r.doc_id) for r in pieces if r.sequence_id == of_seed)
    assert [d for _, d in first[:2]] == [1, 4]


@pytest.mark.parametrize("text", ["a  b  c   d", "it's <|endoftext|> ok <|endoftext|>", " lead", "tail \n", "é ß\u0085 x 12 34", "　 　x "])
def test_segments_encode_like_the_tokenizer(text):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, _ = packing.Segments(RANKS, public_tokenizers.PATTERN).encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]


def test_segments_with_accents_are_encoded_in_one_call(monkeypatch):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(8)
    body = lambda: "".join(rnd.choice("abcdeéèß") for _ in range(6))
    text = " ".join(["x", *(f"a{body()}é" for _ in range(300)), *(f"é{body()}a" for _ in range(300)), *(f"z{body()}z" for _ in range(300))])
    enc, calls = packing.Segments(RANKS, public_tokenizers.PATTERN), []
    one = enc._ids
    monkeypatch.setattr(enc, "_ids", lambda t: calls.append(t) or one(t))
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, _ = enc.encode(raw, np.array([0, len(raw)]))
    assert ids.tolist() == [*tok.encode(text, add_special_tokens=False).ids, 0]
    assert len(calls) < 10


@pytest.mark.parametrize("raw", ["é\u00a0 x\u00a0 é é\u3000 y".encode(), " é \u00a0 ab\u0085 cd é".encode(), b"ab cd\xc3 ef g\xffh \xe2\x82 ij k\xff", b"", b" ", b"a"])
def test_segments_with_odd_ends_encode_like_whole_texts(raw):
    enc = packing.Segments(RANKS, public_tokenizers.PATTERN)
    for _ in range(2):
        ids, _ = enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == [*enc._ids(raw), 0]


def test_statistics_count_each_term_once_a_document(spark):
    rows = [[5, 5, 7, 0], [7, 0], [0], [65535, 5, 0]]
    tokens = spark.createDataFrame([(i, np.array(r, "<u2").tobytes()) for i, r in enumerate(rows)], "doc_id long, ids binary").repartition(2)
    df, n, mean = packing.statistics(tokens)
    assert {int(k): int(df[k]) for k in np.flatnonzero(df)} == {0: 4, 5: 2, 7: 2, 65535: 1} and (n, mean) == (4, 2.5)


def jaccard_components(rows):
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate(TR))
        sets.append(frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    name = [i for i, _ in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[root(a)] = root(b)
    low = {}
    for a in range(len(rows)):
        low.setdefault(root(a), []).append(name[a])
    return bag((name[a], len(sets[a]), min((x for x in low[root(a)] if x is not None), default=None)) for a in range(len(rows)))


def test_jaccard_components(docs, corpus, empty):
    assert bag(map(tuple, near_dup.near_duplicates(docs).collect())) == jaccard_components(corpus)
    assert near_dup.near_duplicates(empty).count() == 0


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_texts_and_sets_that_go_are_not_shuffled(spark, corpus, docs, no_broadcast, monkeypatch):
    plans, stage = {}, near_dup.staged

    def spy(df, name, *args, conf=None, **kw):
        for k, v in (conf or {}).items():
            spark.conf.set(k, v)
        plans[name] = df.select("*")._jdf.queryExecution().optimizedPlan().toString()
        for k in conf or {}:
            spark.conf.unset(k)
        return stage(df, name, *args, **({"conf": conf} if conf else {}), **kw)

    monkeypatch.setattr(near_dup, "staged", spy)
    assert bag(map(tuple, near_dup.near_duplicates(docs).collect())) == jaccard_components(corpus)
    assert "might_contain" in plans["near-sets"] and "might_contain" in plans["near-candidates"]


def test_rows_that_stay_are_not_shuffled(spark, docs, no_broadcast, monkeypatch, tmp_path):
    import corpus_pipeline
    from featloom.llm import common

    words = [r.text for r in docs.where("length(text) > 300").orderBy("doc_id").limit(1).collect()]
    spark.createDataFrame([("1", words[0])], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = docs.withColumn("source", F.lit("s")).withColumn("n_chars", F.length("text").cast("long")).select(*corpus_pipeline.COLUMNS)
    for stage in (corpus_pipeline.jaccard_regions, corpus_pipeline.benchmark_index):
        got = []
        for most in (common.BROADCAST_KEYS, 0):
            monkeypatch.setattr(common, "BROADCAST_KEYS", most)
            out = stage(spark, rows, str(tmp_path))
            assert ("SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()) == (most == 0)
            got.append(bag(map(tuple, out.collect())))
            monkeypatch.undo()
        assert got[0] == got[1] and 0 < len(got[0]) < rows.count()


def test_one_of_each_group_stays(docs, corpus):
    kept = [r.doc_id for r in near_dup.keep_one(docs).select("doc_id").collect()]
    assert bag(kept) == bag({c for _, _, c in jaccard_components(corpus)})


def test_links_do_not_depend_on_doc_ids(spark):
    words = [f"w{k}" for k in range(100)]
    change = lambda base, *at: " ".join("new" if k in at else w for k, w in enumerate(base))
    bridge = [f"b{k}" for k in range(100)]
    other, third = [f"o{k}" for k in range(100)], [f"t{k}" for k in range(100)]
    rows = [
        (10, change(words)), (None, change(words, 50)), (None, change(words, 50)),  # near copies without an id
        (21, change(bridge, 10, 30)), (None, change(bridge)), (20, change(bridge, 60, 80)),  # linked only by a row without an id
        (30, change(other)), (30, change(third)), (31, change(other, 40)), (32, change(third, 40)),  # two texts of one id
        (None, "none of these has an id " * 2), (None, "none of these has an id " * 2), (None, None), (40, ""),
    ]
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows[3:6]]
    alike = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    name = [10] * 3 + [20] * 3 + [30] * 4 + [None] * 3 + [40]
    got = [(r.doc_id, r.component_id) for r in near_dup.near_duplicates(docs).collect()]
    assert bag(got) == bag(zip([i for i, _ in rows], name))
    kept = [tuple(r) for r in near_dup.keep_one(docs).collect()]
    assert bag(kept) == bag([rows[0], rows[5], rows[6], rows[7], rows[10], rows[12], rows[13]])


def test_components_stage_once_a_round_and_end_at_stars(spark, monkeypatch):
    rnd = random.Random(4)
    star = [(9, k) for k in range(2, 9)] + [(k, 9) for k in range(2, 9)] + [(3, 3), (9, 4)]
    chain = [(k, k + 1) for k in rnd.sample(range(100, 140), 40)]
    loose = [(rnd.randrange(200, 260), rnd.randrange(200, 260)) for _ in range(45)]
    rounds, stage = [], near_dup.staged
    monkeypatch.setattr(near_dup, "staged", lambda df, name, *args, **kw: rounds.append(name) or stage(df, name, *args, **kw))
    for edges, most in ((star, 1), (star + chain + loose, 9), ([], 1)):
        low = {x: x for e in edges for x in e}
        for _ in low:
            for a, b in edges:
                low[a] = low[b] = min(low[a], low[b])
        rounds.clear()
        got = near_dup.components(spark.createDataFrame(edges, "a long, b long").repartition(3))
        assert bag(map(tuple, got.collect())) == bag((x, c) for x, c in low.items() if x != c)
        assert 0 < len(rounds) <= most


def test_quality(spark, docs, corpus, empty):
    labels = spark.createDataFrame([(0, 1, 0), (10, 1, 0), (11, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    want = []
    for i, t in corpus:
        t = t or ""
        w = SPACE.findall(t)
        grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
        count, hit = collections.Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                hit.update(range(k, k + 5))
        lines = [x for x in t.split("\n") if x.strip(ASCII_SPACE)]
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit),
                     len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    out = quality.run(docs, labels)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert bag(map(tuple, out.select(cols).collect())) == bag(want)
    assert out.where("base_failed AND kept").count() == 0 and out.where("kept AND llr < -100000").count() == 0
    assert quality.run(empty, labels).count() == 0


def test_quality_score_is_the_mean_log_ratio(spark):
    import math

    import xxhash

    d = spark.createDataFrame([(1, "a b a"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    h = lambda w: signed(xxhash.xxh64(w, 42).intdigest())
    pair = lambda x, y: signed(xxhash.xxh64(y.to_bytes(8, "little", signed=True), xxhash.xxh64(x.to_bytes(8, "little", signed=True), 42).intdigest()).intdigest())
    n, feats = quality.BUCKETS, {}
    for i, ws in ((1, "a b a".split()), (2, "c d".split())):
        v = [h(w) for w in ws]
        feats[i] = [x % n for x in v] + [pair(x, y) % n for x, y in zip(v, v[1:])]
    raw, good = collections.Counter(feats[1] + feats[2]), collections.Counter(feats[1])
    weight = lambda b: round(1e6 * (math.log((good[b] + 1) / (sum(good.values()) + n)) - math.log((raw[b] + 1) / (sum(raw.values()) + n))))
    for r in quality.run(d, labels).collect():
        total = sum(weight(b) for b in feats[r.doc_id])
        assert abs(r.llr - int(total / len(feats[r.doc_id]))) <= 1


def test_line_runs(docs, corpus, empty):
    key = lambda x: x.strip(ASCII_SPACE).translate(TR)
    big = 2**63
    owner = {}
    for i, t in corpus:
        for x in (t or "").split("\n"):
            owner[key(x)] = min(owner.get(key(x), big), big if i is None else i)
    want = []
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == (big if i is None else i)]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    for batches in (1, 4):
        out = line_dedup.dedup(docs, batches).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
        assert bag(map(tuple, out.collect())) == bag(want)
    assert line_dedup.dedup(empty).count() == 0


def test_runs_are_merged_level_by_level(spark):
    runs = line_dedup.LineRuns(spark, buckets=2, fanout=2)
    for k in range(5):
        runs.add(spark.createDataFrame([(k, k)], "h1 long, h2 long"))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    keys = spark.range(7).selectExpr("id AS h1", "id AS h2", "id + 100 AS owner")
    with line_dedup.stored_order(spark):
        got = {r.h1: (r.owner, r.seen) for r in runs.mark_seen(keys).collect()}
    assert got == {k: (k + 100, k < 5) for k in range(7)}
    runs.drop()
    assert runs.paths == {} and not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]


def test_runs_are_neither_shuffled_nor_sorted_again(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = line_dedup.LineRuns(spark)
    assert runs.buckets == n
    for k in range(3):
        runs.add(spark.range(1000 * k, 1000 * k + 1000).selectExpr("id AS h1", "-id AS h2"))
    tables = [t for level in runs.levels for t in level]
    assert len(tables) == 2
    keys = spark.range(5000).selectExpr("id AS h1", "-id AS h2", "id AS did").groupBy("h1", "h2").agg(F.min("did").alias("owner"))
    with line_dedup.stored_order(spark):
        seen = runs.mark_seen(keys)
        plan = seen._jdf.queryExecution().executedPlan().toString()
        # One exchange and one sort: those of the new keys.
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1 and plan.count("SortMergeJoin") == 2
        assert seen.where("seen").count() == 3000 and seen.count() == 5000
        plan = runs.merged(*tables)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort [" not in plan and "SortMergeJoin" in plan
        assert runs.merged(*tables).distinct().count() == 3000
    assert spark.conf.get(line_dedup._ORDER) == "false"
    runs.drop()


def secret_spans(text):
    found = []
    for order, (kind, rx, group, least) in enumerate([
            ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
            ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]):
        found += [(m.start(), order, m.end(), kind) for m in rx.finditer(text) if len(m[group]) >= least]
    return sorted(found)


def test_secrets(docs, corpus, empty):
    want = []
    for i, t in corpus:
        s = secret_spans(t or "")
        want.append((i, *(sum(x[3] == k for x in s) for k in secrets.BASE), sha(",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in s))))
    out = secrets.digest(secrets.scan_documents(docs)).drop("spans").collect()
    assert bag(map(tuple, out)) == bag(want) and sum(r.n_assign for r in out) == 1
    assert secrets.digest(secrets.scan_documents(empty)).count() == 0


def test_ledger_scans_only_what_is_new(spark):
    ledger = secrets.Ledger(spark)
    one = spark.createDataFrame([(1, "token=abcdefgh"), (2, "plain")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "token=abcdefgh"), (4, "secret: zzzzzzzz"), (5, None)], "doc_id long, text string")
    secrets.scan_documents(one, ledger=ledger).count()
    before = ledger.scanned().count()
    got = {r.doc_id: r.spans for r in secrets.digest(secrets.scan_documents(two, ledger=ledger)).collect()}
    assert got == {3: "assign:0:14", 4: "assign:0:16", 5: ""}
    assert ledger.scanned().count() == before + 2 * len(secrets.RULES) and ledger.findings().count() == 2
    newer = tuple(secrets.Rule(**{**r.__dict__, "version": 2}) if r.kind == "assign" else r for r in secrets.RULES)
    secrets.scan_documents(two, newer, ledger).count()
    assert ledger.scanned().where("version = 2").count() == 3


def test_url_rules(spark):
    urls = ["http://a.net/x", "https://EXAMPLE.net/en/1?x=/de/", "http://example.com/de/", "http://blog.example.com/de/z#f", "http://notexample.com/de/",
            "http://w.org/fr/1", "http://org/fr", "http://a.net", None, "no scheme", "http://b.io?u=http://c.net/", "http://b.io?u=http://c.net/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], url_filter.RULE)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.verdicts(pages, none).collect()}
    assert got[0] == ("a.net", "/x", "net/", "block") and got[1] == ("example.net", "/en/1", "example.net/en/", "allow")
    assert got[2][2:] == got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow")
    assert got[5][2:] == ("org/fr/", "allow") and got[6][2:] == (None, "allow") and got[7] == ("a.net", "", None, "allow")
    assert got[8] == got[9] == ("", "", None, "allow") and got[10] == got[11] == ("b.io", "", None, "allow")


def test_url_rules_are_mined(spark):
    rows = [(i, f"http://{'spam' if i % 3 == 0 else 'good'}.io/{'en' if i % 2 else 'de'}/{i}") for i in range(240)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 240)], "doc_id long, quality int, toxic int")
    rules = url_filter.mine(pages, labels)
    assert {(*r.tokens, r.verdict) for r in rules.collect()} == {("host:spam", "block"), ("host:good", "allow")}
    got = {r.page_id: r.verdict for r in url_filter.verdicts(pages, rules).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(240)}
    assert url_filter.verdicts(pages.where("false"), url_filter.mine(pages.where("false"), labels)).count() == 0


def test_url_rules_equal_brute_force(spark):
    rnd, n, z = random.Random(5), 200, 2.0
    rows = []
    for i in range(n):
        host, top, lang = rnd.choice(["ads", "news", "shop", "blog"]), rnd.choice(["com", "info"]), rnd.choice(["en", "de", "fr"])
        odds = 0.95 if host == "ads" or (top, lang) == ("info", "fr") else 0.05 if host == "news" else 0.4
        rows.append((i, f"http://{host}.{top}/{lang}/{i}", rnd.random() < odds))
    pages = spark.createDataFrame([r[:2] for r in rows] + [(900, None), (901, "no scheme")], "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not bad), 0) for i, _, bad in rows] + [(900, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    have = {i: {f"host:{x}" for x in u.split("/")[2].split(".")} | {f"path:{u.split('/')[3]}", "path:#", "scheme:http"} for i, u, _ in rows}
    counts = collections.defaultdict(lambda: [0, 0])
    for i, _, bad in rows:
        for k in range(1, len(have[i]) + 1):
            for c in itertools.combinations(sorted(have[i]), k):
                counts[c][bad] += 1
    share = sum(r[2] for r in rows) / n
    want = {}
    for c, (good, bad) in counts.items():
        for verdict, hits, base in (("block", bad, share), ("allow", good, 1 - share)):
            p, t = hits / (good + bad), good + bad
            lowest = (p + z * z / 2 / t - z * (p * (1 - p) / t + z * z / 4 / t / t) ** 0.5) / (1 + z * z / t)
            if hits / n >= 0.002 and p >= 0.8 and lowest > base:
                want[c, verdict] = p
    least = {(c, v): p for (c, v), p in want.items() if not any(w == v and set(d) < set(c) for d, w in want)}
    rules = url_filter.mine(pages, labels, z=z)
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in rules.collect()}
    assert got.keys() == least.keys() and all(abs(got[k] - least[k]) < 1e-9 for k in got) and {v for _, v in got} == {"block", "allow"}
    said = {i: max([(p, v) for (c, v), p in least.items() if set(c) <= have[i]], default=(0, "allow"))[1] for i in have}
    said |= {900: "allow", 901: "allow"}
    assert {r.page_id: r.verdict for r in url_filter.verdicts(pages, rules, ()).collect()} == said
    # Labels that have nothing to do with the URL give no rule.
    coin = spark.createDataFrame([(i, rnd.randrange(2), 0) for i in range(n)], labels.schema)
    assert url_filter.mine(pages, coin).count() == 0
    assert url_filter.mine(pages, labels.where("quality = 1")).count() == 0


def test_chat_round_trip(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", said), (1, 0, "user", said), (2, 0, None, None), (2, 0, "system\n%0A", "<\\/s> <s>\\ [\\\\/INST] [/INST"), (2, 1, "assistant", "ß" * 3000),
            (2, 1, "assistant", "<"), (None, None, "user", "x\n"), (3, 0, "user", "")] + [(4, k, "assistant" if k % 2 else "user", f"t{k}") for k in range(300)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = []
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        loss = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        want.append((c, len(mine), sha("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)), len(loss), sha(loss)))
    formatted = chat.format_conversations(turns)
    chars = {r.conv_id: r.n for r in formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    out = chat.read_back(chat.format_conversations(turns)).collect()
    assert bag(tuple(r)[:5] for r in out) == bag(want) and all(chars[r.conv_id] == r.formatted_chars for r in out)
    assert chat.read_back(chat.format_conversations(turns.where("false"))).count() == 0


def test_warc_round_trip(spark, tmp_path):
    same = "é" * 600
    pages = [(1, "http://a/\r\nx", same), (2, "http://b/", same), (3, None, same), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", "ab\r\n\r\n" * 300),
             (3, None, same)]
    path = str(tmp_path / "warc")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), path)
    read = warc.read_archives(spark, path)
    got = bag((r.page_id, r.record_type, r.refers_to, r.payload_digest, r.payload_length, None if r.payload is None else bytes(r.payload)) for r in read.collect())
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        kind = h == same and i != 3
        want.append((i, "revisit" if kind else "response", 3 if kind else None, hashlib.sha1(raw).hexdigest(), len(raw), None if kind else raw))
    assert got == bag(want)
    assert read.where("record_type = 'revisit'").count() == 2 and read.where("page_id = 4").select("payload").first()[0] == b"short"
    assert warc.read_archives(spark, path, payload=False).where("payload IS NOT NULL").count() == 0
    empty = str(tmp_path / "none")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_warc_paths_by_scheme():
    assert warc._uri("s3a://bucket/a b") == "s3://bucket/a b" and warc._uri("hdfs://name:8020/x") == "hdfs://name:8020/x"
    assert warc._uri("file:/tmp/x") == "file:/tmp/x" and warc._uri("/tmp/x:y") == "/tmp/x:y" and os.path.isabs(warc._uri("x"))
    with pytest.raises(ValueError, match="wasb.*file, hdfs"):
        warc._uri("wasb://box/x")


def test_warc_members_are_gzip_and_skippable(tmp_path):
    rows = [warc.record_bytes(types.SimpleNamespace(page_id=i, url=f"http://h/{i}", record_type="response", refers_to=None, payload_digest="d",
                                                    payload_length=len(p), payload=p)) for i, p in enumerate([b"", b"x" * 300_000, os.urandom(50_000)])]
    packed = b"".join(map(warc.member, rows))
    assert gzip.decompress(packed) == b"".join(rows)
    path = tmp_path / "one.warc.gz"
    path.write_bytes(packed)
    with open(path, "rb") as f:
        at = 0
        for i, raw in enumerate(rows):
            m = warc._Member(f, at)
            assert m.header()["warc-record-id"] == f"<urn:page:{i}>" and len(m._raw) <= 2 * m.STEP
            n = int(m.header()["content-length"])
            assert m.body(n) == raw[len(raw) - 4 - n:len(raw) - 4]
            at = m.end
        assert at == len(packed)
    path.write_bytes(packed[:-1] + bytes([packed[-1] ^ 1]))
    with open(path, "rb") as f:
        m = warc._Member(f, len(packed) - len(warc.member(rows[2])))
        m.header()
        n = int(m.header()["content-length"])
        with pytest.raises(ValueError):
            m.body(n)


def test_quality_filter_stays_above_the_counts(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    kept = quality.run(docs, labels).where("kept").select("doc_id", "text")
    assert kept._jdf.queryExecution().optimizedPlan().toString().count("array_remove(split(") == 1


def test_families_of_loose_copies_equal_brute_force(spark, monkeypatch):
    """Many classes around one text, few of them linked, share their frequent shingles; blocks instead of pairs."""
    from featloom.llm import common, near_dup

    rnd = random.Random(11)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(70):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4])):
            at = rnd.randrange(100)
            w[at] = f"x{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    sets = [{" ".join(t.split()[i:i + 5]) for i in range(96)} for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 1 < len(set(root)) < len(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for levels, few, block in ((0, 4, 16), (0, 4, 1024), (1, 4, 16), (0, 1000, 16)):
        monkeypatch.setattr(near_dup, "LEVELS", levels)
        monkeypatch.setattr(near_dup, "FEW", few)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        with common.staging_scope() as folders:
            got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
        common.discard_folders(spark, folders)
        assert got == dict(enumerate(root)), (levels, few, block)


def test_segment_cache_grows_and_starts_anew():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from featloom.llm import packing
    from featloom.llm.catalog import RANKS

    enc = packing.Segments(RANKS, public_tokenizers.PATTERN)
    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rnd = random.Random(5)
    texts = ["", " ", "a", " <|endoftext|> b", "x  y\n z", "é ü 'll we'll", *(" ".join(rnd.choice(["ab", "c'd", "é1", "--", "日本", "\n", "", "Q<|endoftext|>"]) + str(rnd.randrange(99)) for _ in range(200)) for _ in range(30))]
    enc.clear(64)  # far too small: every call starts anew or grows
    for part in (texts[:5], texts, texts[5:20], texts[::-1]):
        raw = [t.encode() for t in part]
        ids, offs = enc.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        got = [ids[a:z].tolist() for a, z in zip(offs, offs[1:])]
        assert got == [whole.encode(t, add_special_tokens=False).ids + [0] for t in part]


def old_span_hashes(raw, s, e):
    """Hashes of spans by one sum over all bytes."""
    up, down = common._powers(common._BASE, len(raw) + 1), common._powers(common._inverse(common._BASE), len(raw) + 1)
    pre = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common._BYTE[raw] * up[:-1])])
    return common.mix((pre[e] - pre[s]) * down[s] + (e - s).astype(np.uint64) * common._STEP)


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_spans_are_hashed_block_by_block(monkeypatch, block):
    monkeypatch.setattr(common, "HASH_BLOCK", block)
    rng = np.random.default_rng(block)
    for n in (0, 1, 2, 7, 300):
        raw = rng.integers(0, 256, n).astype(np.uint8)
        for k in (0, 1, 5, 40):
            cuts = np.sort(rng.integers(0, n + 1, 2 * k))
            for s, e in ((cuts[::2], cuts[1::2]), (cuts[:-1], cuts[1:])):
                assert common.span_hashes(raw, s, e).tolist() == old_span_hashes(raw, s, e).tolist()


def test_hashing_a_long_text_holds_no_arrays_of_its_length(monkeypatch):
    monkeypatch.setattr(common, "_TABLE", common._PowerTable())
    raw, e = np.full(8 << 20, 97, np.uint8), np.empty(0, np.int64)
    spans = np.arange(0, len(raw), 1 << 16)
    tracemalloc.start()
    try:
        common.span_hashes(raw, spans, spans + 5)
        common.span_hashes(raw, e, e)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert kept < 4 << 20 and peak < 16 << 20


def test_python_workers_get_batches_of_bounded_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    rows = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    with common.staging_scope() as folders:
        got = common.staged(rows.mapInArrow(sizes, "n long, bytes long"), "sizes").collect()
    common.discard_folders(spark, folders)
    assert sum(r.n for r in got) == 400
    assert max(r.bytes for r in got) < 2 * common.BATCH_BYTES


def test_segment_cache_is_bounded_by_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_IDS", 100)
    enc = packing.Segments(RANKS, public_tokenizers.PATTERN)
    whole = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for i in range(20):
        raw = f"日本{i}語".encode() * 10
        ids, _ = enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ids.tolist() == whole.encode(raw.decode(), add_special_tokens=False).ids + [0]
        assert len(enc.flat) <= 100 + len(ids)


def test_rounds_of_components_are_few_files(spark, monkeypatch):
    written = []

    def staged(df, name, *args, **kwargs):
        out = common.staged(df, name, *args, **kwargs)
        written.append((name, len(out.inputFiles())))
        return out

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 3000) if i % 7], "a long, b long")
    monkeypatch.setattr(near_dup, "staged", staged)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with common.staging_scope() as folders:
            got = {r.id: r.comp for r in near_dup.components(edges).collect()}
        common.discard_folders(spark, folders)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {i: (i - 1) // 7 * 7 + 1 for i in range(1, 3001) if i % 7 != 1}
    assert written and max(n for _, n in written) <= spark.sparkContext.defaultParallelism

"""Exact n-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

Jaccard distance d = 1 - J is a metric; documents link when d <= r (r = 0.2).

1. Equal shingle sets are one class (128-bit set key); its id is the smallest
   staged row id of its rows.  Everything below works on classes; doc_ids, which
   may be null or repeated, only name the components at the end.
2. Exact pruning.  A class with a partner lacks at most r * n of its n shingles
   in that partner, so a class with more than r * n shingles that no other class
   has is alone.  This is tested on the shingles below a fixed hash bound first
   and on all shingles of the survivors then.
3. Pivots: classes are bucketed by a min-hash over their more frequent shingles
   and the most typical class of a bucket becomes a pivot; of two pivots within
   r the more typical stays.  All (class, pivot) pairs within 2r are
   found by a prefix join (rarest shingles first) and measured exactly.
4. Voronoi regions: a class within r of a pivot belongs to its nearest one and
   links to it.  If x is at home with p and y links to x, then d(y, p) <= 2r: so
   y, if not linked to p's component yet, is replicated into p's region as a
   boundary document and compared with those x for which the triangle inequality
   leaves |d(x, p) - d(y, p)| <= r.  Large regions are split into blocks.
5. Classes without a home recur with new pivots.  When a level no longer shrinks
   them, each is its own region and a prefix join at radius r finishes; classes that
   share a frequent prefix shingle are compared in blocks instead of as pairs.

The join is exact; links inside a region that cannot change the components are
not enumerated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import (ASCII_FOLD, NOT_SPACE, bloom, chunks, discard, discard_folders, few_files, gram_hashes, mix, span_hashes,
                                  staged, staging_scope, text_buffer, without, word_spans)

SHINGLE = 5
#: Similarity in percent at which two documents link.
PERCENT = 80
#: Share of the hash space that the first pruning test reads.
REGION = 0.3
#: Levels of pivots before the rest is joined directly; a level must settle this share of its classes.
LEVELS, SHRINK = 2, 0.15
#: Rows of a block of a region or family, and shingles of a block of a family.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 22
#: Prefixes that hold a shingle up to which their pairs are listed.
FEW = 16


def shingle_sets(col: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the n+1 offsets.

    A text of fewer words than ``n`` has its whole word sequence as one shingle.
    """
    raw, offs = text_buffer(col)
    s, e, doc = word_spans(raw, offs, NOT_SPACE)
    words = span_hashes(raw, s, e, ASCII_FOLD)
    grams, owner = gram_hashes(words, n), doc[:max(len(doc) - n + 1, 0)]
    same = owner == doc[n - 1:] if len(words) >= n else np.empty(0, bool)
    grams, owner = grams[same], owner[same]
    count = np.bincount(doc, minlength=len(offs) - 1)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = [mix(gram_hashes(words[first[d]:first[d] + count[d]], count[d]) + np.uint64(count[d])) for d in short]
        grams, owner = np.concatenate([grams, *whole]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    if len(grams):
        keep = np.ones(len(grams), bool)
        keep[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[keep], owner[keep]
    return grams, np.searchsorted(owner, np.arange(len(offs)))


def set_keys(grams: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit keys of every set (sums of mixed hashes), as signed longs."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(grams ^ np.uint64(salt)))])
        out.append((total[offs[1:]] - total[offs[:-1]]).view(np.int64))
    return out[0], out[1]


def classes_of(texts: DataFrame) -> DataFrame:
    """One row per row of ``texts``: (rid, doc_id, n, k1, k2, low): set size, set key, shingles below the region bound."""

    def run(batches):
        for b in chunks(batches):
            grams, offs = shingle_sets(b.column(2))
            k1, k2 = set_keys(grams, offs)
            low = np.concatenate([[0], np.cumsum(grams < _bound(REGION))])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(np.diff(offs), pa.int64()), pa.array(k1), pa.array(k2), pa.array(low[offs[1:]] - low[offs[:-1]], pa.int64())],
                names=["rid", "doc_id", "n", "k1", "k2", "low"])

    return texts.select("rid", "doc_id", "text").mapInArrow(run, "rid long, doc_id long, n long, k1 long, k2 long, low long")


def _bound(share: float) -> np.uint64:
    return np.uint64(min(int(share * 2**64), 2**64 - 1))


def _six(a: np.ndarray) -> bytes:
    """The low six bytes of every value."""
    return a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def shared_counts(rows: DataFrame, share: float, from_text: bool) -> DataFrame:
    """(k1, n_shared): how many shingles below ``share`` of the hash space another class has too.

    Every chunk of texts first settles what it can: shingles that two of its own
    classes have are counted there, and of each shingle one owner goes to the
    exchange, so a shingle that a third of all documents have is as many entries
    as there are chunks.  The exchange moves blocks of 12-byte (shingle, owner)
    entries by hash bucket.  Truncated hashes can only make a class look shared.
    """
    buckets = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "bucket int, chunk long, entries binary, owners binary, counts binary"

    def deal(batches):
        chunk = TaskContext.get().partitionId() << 36
        for b in chunks(batches, col="text" if from_text else "toks"):
            if from_text:
                grams, offs = shingle_sets(b.column(1))
                keys = set_keys(grams, offs)[0].view(np.uint64)
            else:
                raw, offs = text_buffer(b.column(1))
                grams, offs = raw.view("<u8") if len(raw) else np.empty(0, np.uint64), offs // 8
                keys = b.column(0).to_numpy().view(np.uint64)
            owner = np.repeat(keys, np.diff(offs))
            if share < 1:
                below = grams < _bound(share)
                grams, owner = grams[below], owner[below]
            token = (grams >> np.uint64(1)) & np.uint64(2**48 - 1)
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner = token[new], owner[new]
            first = np.flatnonzero(np.diff(token, prepend=token[:1] ^ np.uint64(1)) != 0) if len(token) else np.empty(0, np.int64)
            runs = np.diff(np.append(first, len(token)))
            local = np.repeat(runs > 1, runs)
            who, n = np.unique(owner[local], return_counts=True)
            # Of a shingle with several local owners two stay as evidence for other chunks, without an answer.
            place = np.arange(len(token)) - np.repeat(first, runs)
            send = place < 2
            token, owner, local = token[send], owner[send], local[send]
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, owner, local, bucket = token[order], owner[order], local[order], bucket[order]
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(bucket)) if len(cut) else cut
            rows = [(int(bucket[a]), chunk, _six(token[a:z]), _six(owner[a:z]), np.packbits(local[a:z]).tobytes()) for a, z in zip(cut, ends)]
            rows.append((int(chunk % buckets), chunk, None, who.tobytes(), n.astype(np.int64).tobytes()))
            chunk += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                             names=["bucket", "chunk", "entries", "owners", "counts"])

    def settle(table: pa.Table) -> pa.Table:
        known, tokens, owners, local, chunk = [], [], [], [], []
        for c, e, o, n in zip(*(table.column(i).to_pylist() for i in range(1, 5))):
            if e is None:
                known.append((np.frombuffer(o, np.uint64), np.frombuffer(n, np.int64), np.full(len(o) // 8, c)))
            else:
                tokens.append(_from_six(e))
                owners.append(_from_six(o))
                local.append(np.unpackbits(np.frombuffer(n, np.uint8), count=len(tokens[-1])).astype(bool))
                chunk.append(np.full(len(tokens[-1]), c))
        out = [(k & np.uint64(2**48 - 1), n, c) for k, n, c in known]
        if tokens:
            t, o, l, c = map(np.concatenate, (tokens, owners, local, chunk))
            order = np.lexsort((o, t))
            t, o, l, c = t[order], o[order], l[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            runs = np.diff(np.append(first, len(t)))
            several = np.minimum.reduceat(o, first) != np.maximum.reduceat(o, first)
            answer = np.repeat(several, runs) & ~l
            pairs = np.stack([o[answer], c[answer].astype(np.uint64)], 1)
            if len(pairs):
                pairs, n = np.unique(pairs, axis=0, return_counts=True)
                out.append((pairs[:, 0], n, pairs[:, 1].astype(np.int64)))
        who, n, c = (np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in range(3))
        return dealt(who, c, n, lambda to: to // side + table.column("bucket")[0].as_py() // side * side)

    def dealt(who, c, n, key) -> pa.Table:
        """Answers (class, chunk, count) as one blob for each value of ``key`` of their target bucket."""
        who, c, n = who.astype(np.int64), c.astype(np.int64), n.astype(np.int32)
        to = key(who % buckets)
        order = np.argsort(to, kind="stable")
        who, n, c, to = who[order], n[order], c[order], to[order]
        cut = np.flatnonzero(np.diff(to, prepend=-1))
        ends = np.append(cut[1:], len(to)) if len(cut) else cut
        blobs = [[x[a:z].tobytes() for a, z in zip(cut, ends)] for x in (who, c, n)]
        return pa.table({"bucket": pa.array(to[cut].astype(np.int32)), **{k: pa.array(v, pa.binary()) for k, v in zip("ocn", blobs)}})

    def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Answers per class and chunk, added up."""
        who, c, n = (np.frombuffer(b"".join(table.column(k).to_pylist()), t) for k, t in zip("ocn", (np.int64, np.int64, np.int32)))
        order = np.lexsort((c, who))
        who, c, n = who[order], c[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (c[1:] != c[:-1])]))
        return who[first], c[first], np.add.reduceat(n, first)

    def pass_on(table: pa.Table) -> pa.Table:
        who, c, n = summed(table)
        return dealt(who, c, n, lambda to: to)

    def add(table: pa.Table) -> pa.Table:
        """The chunk that knows most about a class counts."""
        who, _, n = summed(table)
        first = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
        return pa.table({"o": pa.array(who[first]), "n_shared": pa.array(np.maximum.reduceat(n, first))})

    # Answers go home in two steps over a square grid of buckets, so that their blobs number
    # buckets ** 1.5 and not buckets ** 2: first from a row of senders to a row of targets.
    side = int(np.ceil(np.sqrt(buckets)))
    blob = "bucket int, o binary, c binary, n binary"
    return (rows.mapInArrow(deal, schema).groupBy("bucket").applyInArrow(settle, blob).groupBy("bucket").applyInArrow(pass_on, blob)
            .groupBy("bucket").applyInArrow(add, "o long, n_shared long"))


def _owner(c: str = "k1"):
    return F.col(c).bitwiseAND(F.lit(2**48 - 1))


def candidate_sets(texts: DataFrame, classes: DataFrame, spare: bool) -> DataFrame:
    """Staged (id, n, toks): classes of which at most r * n shingles are theirs alone, with all shingles.

    Counts are staged before they are joined, so that their exchange is deleted by then.
    Texts and sets that don't survive a test are left out by a Bloom filter before the shuffle.
    """
    loose = 100 - PERCENT
    # A class whose count is missing shares nothing.
    shared = staged(shared_counts(texts.select("rid", "text"), REGION, True), "near-counts")
    first = (classes.join(shared, _owner() == F.col("o"), "left")
             .where(100 * (F.col("low") - F.coalesce("n_shared", F.lit(0))) <= loose * F.col("n"))
             .select("id", "n", "k1"))
    first = staged(few_files(first, classes.count()), "near-first")

    def sets(batches):
        for b in chunks(batches):
            grams, offs = shingle_sets(b.column(1))
            toks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offs.astype(np.int64) * 8), pa.py_buffer(np.ascontiguousarray(grams))])
            yield pa.RecordBatch.from_arrays([b.column(3), toks.cast(pa.binary()), b.column(0), b.column(2)], names=["k1", "toks", "id", "n"])

    found = (texts.select(F.col("rid").alias("id"), "text").join(first.where("n > 0"), "id").select("id", "text", "n", "k1")
             .mapInArrow(sets, "k1 long, toks binary, id long, n long"))
    found = staged(found, "near-sets", conf=bloom(first.count()))
    discard(first, shared, *([texts] if spare else []))
    again = staged(shared_counts(found.select("k1", "toks"), 1.0, False), "near-counts")
    second = staged(found.select("k1", "id", "n").join(again, _owner() == F.col("o"))
                    .where(100 * (F.col("n") - F.col("n_shared")) <= loose * F.col("n")).select("id", "n"), "near-second")
    out = staged(found.select("id", "toks").join(second.where("n > 0"), "id").select("id", "n", "toks"), "near-candidates", conf=bloom(second.count()))
    discard(found, again, second)
    return out


def ranked_shingles(sets: DataFrame) -> DataFrame:
    """Staged, per class: (id, n, shared, typical, buckets, prefix).

    ``shared`` counts the shingles that other classes have too, ``typical`` is their mean frequency.
    ``prefix`` lists the rarest of them, rarest first, as far as a search at 2r reads; the rank of
    entry i is ``n - shared + i``, behind the shingles that only this class has.  ``buckets`` holds a
    min-hash over the more frequent half for each level.
    """

    def explode(batches):
        for b in batches:
            raw, offs = text_buffer(b.column(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), np.diff(offs // 8))),
                                              pa.array(raw.view(np.int64) if len(raw) else np.empty(0, np.int64))], names=["id", "tok"])

    toks = sets.select("id", "toks").mapInArrow(explode, "id long, tok long")
    df = staged(toks.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1"), "near-frequencies")
    # Each of the three shuffles is deleted before the next one begins.
    found = staged(toks.join(df, "tok"), "near-frequent")
    discard(df)
    per = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("t")).join(sets.select("id", "n"), "id")
    per = per.select("id", "n", F.size("t").cast("long").alias("shared"), "t")
    length = F.expr(f"cast(greatest(least(n * {2 * (100 - PERCENT)} div 100 - (n - shared) + 1, shared), 0) AS int)")
    half = F.expr("transform(slice(t, cast((shared + 1) div 2 + 1 AS int), cast(shared - (shared + 1) div 2 AS int)), e -> e.tok)")
    out = staged(per.select(
        "id", "n", "shared", (F.expr("aggregate(t, 0L, (s, e) -> s + e.df)") / F.col("n")).alias("typical"),
        F.array(*[F.array_min(F.transform(half, _hashed(level))) for level in range(LEVELS)]).alias("buckets"),
        F.transform(F.slice("t", F.lit(1), length), lambda e: e.tok).alias("prefix")), "near-shingles")
    discard(found)
    return out


def _hashed(level: int):
    return lambda t: F.xxhash64(t, F.lit(level))


def _prefix(ranked: DataFrame, percent: int, *more: str) -> DataFrame:
    """(id, n, tok, *more): the prefix in which two classes of at least ``percent`` similarity share a shingle."""
    rows = ranked.select("id", "n", "shared", *more, F.posexplode("prefix").alias("i", "tok"))
    return rows.where(100 * (F.col("n") - F.col("shared") + F.col("i")) <= (100 - percent) * F.col("n")).select("id", "n", "tok", *more)


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` of classes (a, b and more columns) with ``both`` and ``total``: the sizes of the intersection and the union.

    The side of the few pivots, b, is joined first: a pivot with many pairs is split while rows
    are still short, and the sets meet dealt by a.
    """
    n = len(pairs.columns)

    def overlap(batches):
        for b in batches:
            x, y = b.column(n).to_pylist(), b.column(n + 1).to_pylist()
            both = np.array([len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)) for p, q in zip(x, y)], np.int64)
            union = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64) // 8 - both
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(both), pa.array(union)], names=[*b.schema.names[:n], "both", "total"])

    side = sets.select("id", "toks")
    rows = (pairs.join(side.withColumnsRenamed({"id": "b", "toks": "tb"}), "b")
            .join(side.withColumnsRenamed({"id": "a", "toks": "ta"}), "a").select(*pairs.columns, "ta", "tb"))
    return rows.mapInArrow(overlap, ", ".join(f"{c} {t}" for c, t in [*pairs.dtypes, ("both", "long"), ("total", "long")]))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): connected components by alternating large and small stars; comp is the smallest id.

    ``edges`` is read several times: staged rows, which may repeat.
    """
    e, was = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), None
    while True:
        n = e.count()
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("m"))
        large = e.join(low, "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.inline(F.array(*[F.struct(F.col(c).alias("u"), F.col("m").alias("v")) for c in "uv"])))
        e = staged(few_files(small.where("u <> v").distinct(), 2 * n), "cc")  # each edge gives two at most
        if was is not None:
            discard(was)
        if _stars(e):
            return e.select(F.col("u").alias("id"), F.col("v").alias("comp"))
        was = e


def _stars(e: DataFrame) -> bool:
    """Whether each u of the distinct edges (u, v) has one v, which is no u itself: then no round changes them any more."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return not ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").agg(F.count("*")).first()[0]


def region_links(home: DataFrame, border: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): for every border class of a region, a class at home there that it links to, per block.

    ``home`` (p, id, both, total) and ``border`` (p, id, both, total).  Only home
    classes within the triangle-inequality window of some border class of the
    region are sent; each block pair of at most 2 * BLOCK sets is one group.
    """
    sim = 100.0 * F.col("both") / F.col("total")
    h, w = home.withColumn("s", sim), border.withColumn("s", sim)
    reach = w.groupBy("p").agg(F.max("s").alias("top"), F.count("*").alias("nw"))
    h = h.join(reach, "p").where(F.col("s") <= F.col("top") + (100 - PERCENT) + 1e-6)
    sizes = h.groupBy("p").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("hb"), F.ceil(F.first("nw") / BLOCK).cast("int").alias("wb"))
    h = (h.join(sizes, "p").withColumn("i", F.pmod(F.xxhash64("id"), "hb").cast("int"))
         .withColumn("j", F.explode(F.expr("sequence(0, wb - 1)"))).select("p", "i", "j", "id", "s", F.lit(True).alias("home")))
    w = (w.join(sizes, "p").withColumn("j", F.pmod(F.xxhash64("id"), "wb").cast("int"))
         .withColumn("i", F.explode(F.expr("sequence(0, hb - 1)"))).select("p", "i", "j", "id", "s", F.lit(False).alias("home")))
    rows = h.union(w).join(sets.select("id", "toks"), "id").select("p", "i", "j", "id", "s", "home", "toks")

    def join(table: pa.Table) -> pa.Table:
        is_home = np.array(table.column("home").to_pylist(), bool)
        ids, s, toks = table.column("id").to_numpy(), table.column("s").to_numpy(), table.column("toks").to_pylist()
        at, out = np.flatnonzero(is_home), []
        if len(at) and not is_home.all():
            each = [np.frombuffer(toks[k], np.uint64) for k in at]
            size = np.array([len(x) for x in each])
            flat, owner = np.concatenate(each), np.repeat(np.arange(len(at)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for k in np.flatnonzero(~is_home):
                t = np.frombuffer(toks[k], np.uint64)
                a, z = np.searchsorted(flat, t), np.searchsorted(flat, t, side="right")
                n = z - a
                hit = owner[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                both = np.bincount(hit, minlength=len(at))
                linked = np.flatnonzero((100 * both >= PERCENT * (size + len(t) - both)) & (ids[at] != ids[k]))
                if len(linked):
                    out.append((ids[k], ids[at[linked[0]]]))
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("p", "i", "j").applyInArrow(join, "a long, b long")


def links(sets: DataFrame) -> list[DataFrame]:
    """Edge tables (a, b) that connect exactly the classes that links connect."""
    ranked = ranked_shingles(sets)
    loose = 100 - PERCENT
    wide = 100 - 2 * loose
    members = ranked.select("id")
    edges: list[DataFrame] = []
    left = members.count()
    for level in range(LEVELS):
        if not left:
            return edges
        here = ranked.join(members, "id", "left_semi") if level else ranked
        bucket = F.col("buckets")[level].alias("bucket")
        pivots = here.select("id", "typical", bucket).where("bucket IS NOT NULL").groupBy("bucket").agg(F.max_by("id", F.struct("typical", -F.col("id"))).alias("id")).select("id")
        pivots = staged(few_files(pivots, left), "near-pivots")
        prefix = _prefix(here, wide, "typical")
        ys = prefix.select("tok", F.col("id").alias("a"), F.col("n").alias("na"), F.col("typical").alias("ta"))
        ps = prefix.join(pivots, "id", "left_semi").select("tok", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("typical").alias("tb"))
        weak = (F.col("ta") < F.col("tb")) | ((F.col("ta") == F.col("tb")) & (F.col("a") > F.col("b")))
        pairs = (ys.join(ps, "tok").where((F.col("a") != F.col("b")) & (100 * F.least("na", "nb") >= wide * F.greatest("na", "nb")))
                 .select("a", "b", weak.alias("weak")).distinct())
        near = staged(measured(pairs, sets).where(100 * F.col("both") >= wide * F.col("total")), "near-pairs")
        link = 100 * F.col("both") >= PERCENT * F.col("total")
        stay = staged(pivots.join(near.where(link & F.col("weak")).select(F.col("a").alias("id")), "id", "left_anti"), "near-stay")
        of_pivots = near.join(stay.select(F.col("id").alias("b")), "b")
        home = staged(of_pivots.where(link).groupBy("a").agg(F.max_by(F.struct("b", "both", "total"), F.struct(F.col("both") / F.col("total"), -F.col("b"))).alias("h"))
                      .select(F.col("a").alias("id"), F.col("h.b").alias("p"), "h.both", "h.total"), "near-home")
        comp = components(near.where(link))
        edges.append(comp.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        border = (of_pivots.where(~link).select(F.col("b").alias("p"), F.col("a").alias("id"), "both", "total")
                  .join(comp.select("id", F.col("comp").alias("c")), "id", "left")
                  .join(comp.select(F.col("id").alias("p"), F.col("comp").alias("cp")), "p", "left")
                  .where(F.coalesce("c", "id") != F.coalesce("cp", "p")).select("p", "id", "both", "total"))
        border = staged(border, "near-border")
        if not border.isEmpty():
            edges.append(staged(region_links(home, border, sets), "near-links"))
        before, members = members, staged(members.join(home, "id", "left_anti").join(stay, "id", "left_anti"), "near-left")
        discard(near, pivots, stay, home, border, *([before] if level else []))
        was, left = left, members.count()
        if left > (1 - SHRINK) * was:
            break
    if left:
        edges += rest_links(_prefix(ranked.join(members, "id", "left_semi"), PERCENT), sets)
    return edges


def rest_links(rest: DataFrame, sets: DataFrame) -> list[DataFrame]:
    """Edge tables that connect what links connect among the classes whose prefixes ``rest`` (id, n, tok) lists.

    A shingle that at most ``FEW`` prefixes hold gives its pairs, at most ``FEW / 2`` a prefix entry.
    Classes that share a more frequent one form a family (connected over such shingles), which is
    compared in blocks.
    """
    rest = staged(rest, "near-prefixes")
    freq = staged(rest.groupBy("tok").agg(F.count("*").alias("m"), F.min("id").alias("lead")).where("m > 1"), "near-tokens")
    few = staged(rest.join(freq.where(F.col("m") <= FEW).select("tok"), "tok"), "near-few")
    xs, ys = few.select("tok", F.col("id").alias("a"), F.col("n").alias("na")), few.select("tok", F.col("id").alias("b"), F.col("n").alias("nb"))
    pairs = (xs.join(ys, "tok").where((F.col("a") < F.col("b")) & (100 * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")))
             .select("a", "b").distinct())
    edges = [staged(measured(pairs, sets).where(100 * F.col("both") >= PERCENT * F.col("total")).select("a", "b"), "near-rest")]
    many = freq.where(F.col("m") > FEW)
    if not many.isEmpty():
        leads = staged(rest.join(many, "tok").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), "near-leads")
        of = components(leads)
        family = staged(of.union(of.select("comp", "comp").distinct()), "near-families")
        edges.append(staged(family_links(family, sets), "near-family"))
        discard(leads, family)
    discard(rest, freq, few)
    return edges


def family_links(family: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect what all links within each family (id, comp) connect: a forest per pair of blocks."""
    rows = family.join(sets, "id")
    blocks = rows.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("k"))
    rows = rows.join(blocks, "comp").withColumn("own", F.pmod(F.xxhash64("id"), "k").cast("int")).withColumn("x", F.explode(F.expr("sequence(0, k - 1)")))
    rows = rows.select("comp", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "own", "id", "toks")

    def forest(table: pa.Table) -> pa.Table:
        first, own = table.column("i")[0].as_py(), table.column("own").to_numpy()
        ids, toks = table.column("id").to_numpy(), [np.frombuffer(t, np.uint64) for t in table.column("toks").to_pylist()]
        same = first == table.column("j")[0].as_py()
        at = np.flatnonzero(own == first)
        out = []
        if len(at):
            each = [toks[k] for k in at]
            size = np.array([len(x) for x in each])
            flat, owner = np.concatenate(each), np.repeat(np.arange(len(at)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            root = np.arange(len(ids))
            for k in at if same else np.flatnonzero(own != first):
                t = toks[k]
                a, z = np.searchsorted(flat, t), np.searchsorted(flat, t, side="right")
                n = z - a
                both = np.bincount(owner[np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())], minlength=len(at))
                linked = at[100 * both >= PERCENT * (size + len(t) - both)]
                new, pick = np.unique(root[linked], return_index=True)
                for r, y in zip(new.tolist(), linked[pick].tolist()):
                    if r != root[k]:
                        out.append((ids[k], ids[y]))
                        root[root == r] = root[k]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("comp", "i", "j").applyInArrow(forest, "a long, b long")


def linked(texts: DataFrame, spare: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of staged ``texts`` (rid, doc_id, text; rid unique): the rows (see classes_of) and (k1, k2, c).

    ``c`` is the component of a class: the smallest class id in it.  With ``spare`` the texts are
    deleted as soon as their shingles are known.
    """
    rows = staged(classes_of(texts), "near-classes")
    with staging_scope() as folders:
        classes = (rows.where("n > 0").groupBy("k1", "k2").agg(F.min("rid").alias("id"), F.min("doc_id").alias("did"), F.first("n").alias("n"), F.first("low").alias("low")))
        classes = staged(few_files(classes, rows.count()), "near-names")
        sets = candidate_sets(texts, classes, spare)
        edges = links(sets)
        discard(sets)
        names = classes.select("k1", "k2", "id", "did")
        if edges:
            all_edges = edges[0]
            for e in edges[1:]:
                all_edges = all_edges.union(e)
            names = names.join(components(all_edges), "id", "left").withColumn("c", F.coalesce("comp", "id"))
        else:
            names = names.withColumn("c", F.col("id"))
        out = staged(few_files(names.select("k1", "k2", "did", "c"), classes.count()), "near-linked")
    discard_folders(texts.sparkSession, folders, out)
    return rows, out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id).

    A null or empty text, or one without words, has no shingles and is linked
    with nothing.  Rows with equal sets are linked, repeated rows included.
    Links are between rows, whatever their doc_id; a component is named by its
    smallest doc_id, and null if none of its rows has one.
    """
    texts = staged(docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string")), "near-rows")
    rows, names = linked(texts, spare=True)
    names = names.join(names.groupBy("c").agg(F.min("did").alias("comp")), "c").select("k1", "k2", "comp")
    return (rows.join(names, ["k1", "k2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` of each component: the one with its smallest doc_id, a row without an id only if no row has one.

    A row without shingles is linked with nothing and stays.
    """
    whole = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    rows, names = linked(whole.select(F.col("_row").alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string")))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rid")).alias("best")
    # Classes first, so that the rows of a large component meet only as one row per class.
    of_class = rows.where("n > 0").groupBy("k1", "k2").agg(best).join(names, ["k1", "k2"]).select("c", "best.*")
    kept = of_class.groupBy("c").agg(best).select(F.col("best.rid").alias("_row"))
    lost = staged(rows.where("n > 0").select(F.col("rid").alias("_row")).join(kept, "_row", "left_anti"), "near-lost")
    return without(whole, lost, "_row").drop("_row")

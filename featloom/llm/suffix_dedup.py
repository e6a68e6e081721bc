"""Exact repeated-substring removal by distributed prefix doubling.

A byte goes when a 100-byte string that covers it also starts earlier (smaller
document id, or the same document at an earlier byte).

Ranking all positions by (rank, rank at offset) pairs would move over twenty
times the input, so runs of starts are ranked together first.  A start x belongs
to the byte A(x) with the smallest 8-byte hash among the next 64, which depends
only on the string at x: equal strings have equal anchors at equal distance.  An
entry is a run of neighbouring starts with one anchor; it carries two ranks
(hash names, as in Karp-Miller-Rosenberg): ``near``, of the bytes that all
strings of the run share, and ``full``, of all bytes that any of them covers.
Each round sorts the rank pairs:

* a ``near`` rank that is unique settles its run (no string of it occurs twice),
* runs with equal ``full`` ranks hold equal strings: the earliest stays, all
  starts of the others are repeats,
* runs that share ``near`` but not ``full`` are cut into shorter runs, whose
  shared part is longer, and ranked again: 37 shared bytes for runs of up to 64
  starts, then 93 for 8 starts, then all 100 for single starts.

Repeats inside one chunk of texts are settled before the exchange, so a string
that fills a third of the input is as many entries as there are chunks.  The
exchange moves blocks of entries by hash bucket.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import _BASE, _BYTE, _TABLE, chunks, mix, staged, staging_path, text_buffer

THRESHOLD = 100
#: Starts of a run in each round; the anchor is the smallest hash of the first WIDTHS[0] bytes of a string.
WIDTHS = (64, 8, 1)
GRAM = 8
BLOCKS = "bucket int, chunk long, near binary, full binary, uid binary, lo binary, form binary"
NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
SETTLED = "uid long, lo long, hi long, anchor long, again boolean"


def ordered(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``uid``: an id in document order that no two rows share.

    It is the doc_id where ids are unique and not null; otherwise rows are sorted
    by id (nulls last) and text, and numbered.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if rows.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return rows.withColumn("uid", F.col("doc_id"))
    by = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    return staged(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("uid", F.monotonically_increasing_id()), "ordered")


def bucketed(rows: DataFrame) -> DataFrame:
    """``rows`` as a table bucketed by uid: the texts move once, later joins on uid leave them where they are."""
    spark, name = rows.sparkSession, f"repeat_texts_{uuid.uuid4().hex[:12]}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.repartition(n, "uid").write.bucketBy(n, "uid").sortBy("uid").option("compression", "zstd")
     .option("path", staging_path(spark, name)).saveAsTable(name))
    spark._jvm.System.gc()
    return spark.table(name)


def _span(pre: np.ndarray, down: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mix((pre[e] - pre[s]) * down[s] + (e - s).astype(np.uint64) * _BASE)


def _prefix_hash(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _TABLE.get(len(raw) + 1)
    pre = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * up[:len(raw)], out=pre[1:])
    return pre, down


def anchored_runs(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First start, last start and anchor of every run of starts (positions in the buffer)."""
    width, n = WIDTHS[0], len(raw) - GRAM + 1
    e = np.empty(0, np.int64)
    if n < width:
        return e, e, e
    grams = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(raw, GRAM)).view("<u8").reshape(-1)
    grams = grams * np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(max(26, n.bit_length()))
    # The low bits are the position: ties go to the leftmost.
    key = (grams >> bits << bits) | np.arange(n, dtype=np.uint64)
    step = 1
    while step < width:
        np.minimum(key[:len(key) - step], key[step:], out=key[:len(key) - step])
        key = key[:len(key) - step]
        step *= 2
    anchor = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    # Starts whose string ends inside their own text.
    last = np.maximum(offs[1:] - THRESHOLD + 1, offs[:-1])
    delta = np.zeros(len(raw) + 1, np.int8)
    some = last > offs[:-1]
    np.add.at(delta, offs[:-1][some], 1)
    np.add.at(delta, last[some], -1)
    valid = np.cumsum(delta[:len(anchor)], dtype=np.int8) > 0
    new = valid.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    end = valid.copy()
    end[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    # Adjacent texts can both have starts at a border.
    border = offs[1:-1][offs[1:-1] < len(anchor)]
    border = border[valid[border]]
    new[border] = True
    end[border[border > 0] - 1] = valid[border[border > 0] - 1]
    lo, hi = np.flatnonzero(new), np.flatnonzero(end)
    return lo, hi, anchor[lo]


def _pack(chunk: int, buckets: int, near, full, uid, lo, form) -> list[tuple]:
    """Entries as one row per bucket."""
    bucket = (near % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cols = [c[order] for c in (near, full, uid, lo, form)]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cut[1:], len(bucket)) if len(cut) else cut
    return [(int(bucket[a]), chunk, *(c[a:z].tobytes() for c in cols)) for a, z in zip(cut, ends)]


_ARROW = [pa.int32(), pa.int64(), *[pa.binary()] * 5]


def _entries(raw, offs, uids, lo, hi, anchor, near, buckets: int, chunk: int) -> pa.RecordBatch:
    """Blocks of ranked runs.  Repeats inside the chunk go out settled (``near`` null), one of each kind to its bucket."""
    pre, down = _prefix_hash(raw)
    near = _span(pre, down, *near)
    full = _span(pre, down, lo, hi + THRESHOLD)
    doc = np.searchsorted(offs, lo, side="right") - 1
    uid, at = uids[doc], (lo - offs[doc]).astype(np.int32)
    form = np.stack([anchor - lo, hi - lo], 1).astype(np.int32).view(np.int64).reshape(-1)
    full = mix(full ^ form.view(np.uint64))
    order = np.lexsort((at, uid, full))
    first = np.ones(len(order), bool)
    first[1:] = full[order][1:] != full[order][:-1]
    keep, gone = order[first], order[~first]
    rows = _pack(chunk, buckets, near[keep], full[keep], uid[keep], at[keep], form[keep])
    if len(gone):
        rows.append((int(chunk % buckets), chunk, None, None, uid[gone].tobytes(), at[gone].tobytes(), form[gone].tobytes()))
    cols = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW)], names=NAMES)


def _settle(table: pa.Table) -> pa.Table:
    """One bucket of rank pairs: repeated runs, and the runs to cut further (``again``)."""
    done, parts = [], []
    for near, full, uid, lo, form in zip(*(table.column(i).to_pylist() for i in range(2, 7))):
        u, l = np.frombuffer(uid, np.int64), np.frombuffer(lo, np.int32).astype(np.int64)
        f = np.frombuffer(form, np.int32).reshape(-1, 2).astype(np.int64)
        if near is None:
            done.append((u, l, l + f[:, 1], l + f[:, 0], np.zeros(len(u), bool)))
        else:
            parts.append((np.frombuffer(near, np.uint64), np.frombuffer(full, np.uint64), u, l, f[:, 0], f[:, 1]))
    if parts:
        near, full, uid, lo, off, span = (np.concatenate(c) for c in zip(*parts))
        order = np.argsort(near)
        s = near[order]
        same = np.zeros(len(s), bool)
        same[1:] = s[1:] == s[:-1]
        same[:-1] |= same[1:]
        pick = order[same]
        order = pick[np.lexsort((lo[pick], uid[pick], full[pick], near[pick]))]
        near, full, uid, lo, off, span = (c[order] for c in (near, full, uid, lo, off, span))
        group = np.ones(len(near), bool)
        group[1:] = near[1:] != near[:-1]
        first = group.copy()
        first[1:] |= full[1:] != full[:-1]
        starts = np.flatnonzero(group)
        kinds = np.add.reduceat(first, starts) if len(starts) else starts
        several = np.repeat(kinds > 1, np.diff(np.append(starts, len(near))))
        keep = ~first | several
        done.append((uid[keep], lo[keep], (lo + span)[keep], (lo + off)[keep], first[keep]))
    cols = [np.concatenate(c) for c in zip(*done)] if done else [np.empty(0, np.int64)] * 4 + [np.empty(0, bool)]
    return pa.table({k.split()[0]: pa.array(c) for k, c in zip(SETTLED.split(", "), cols)})


def _first_round(texts: DataFrame, buckets: int) -> DataFrame:
    def rank(batches):
        chunk = TaskContext.get().partitionId() << 36
        for b in chunks(batches):
            raw, offs = text_buffer(b.column(1))
            lo, hi, anchor = anchored_runs(raw, offs)
            shared = anchor, anchor + THRESHOLD - WIDTHS[0] + 1
            yield _entries(raw, offs, b.column(0).to_numpy(), lo, hi, anchor, shared, buckets, chunk)
            chunk += 1

    return texts.select("uid", "text").mapInArrow(rank, BLOCKS)


def _next_round(texts: DataFrame, open_runs: DataFrame, width: int, buckets: int) -> DataFrame:
    """Cut the open runs into runs of at most ``width`` starts at fixed distances from the anchor, and rank them."""

    def rank(batches):
        chunk = TaskContext.get().partitionId() << 36
        for b in chunks(batches):
            raw, offs = text_buffer(b.column(1))
            runs = b.column(2)
            n = np.diff(runs.offsets.to_numpy())
            lo, hi, anchor = (runs.flatten().field(i).to_numpy() for i in range(3))
            base = np.repeat(offs[:-1], n)
            # Pieces are cut by distance to the anchor, so that equal strings fall into equal places of a piece.
            a, z = (anchor - hi) // width, (anchor - lo) // width
            k = z - a + 1
            piece = np.repeat(a, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            lo, hi, anchor, base = (np.repeat(c, k) for c in (lo, hi, anchor, base))
            lo, hi = np.maximum(lo, anchor - piece * width - width + 1) + base, np.minimum(hi, anchor - piece * width) + base
            # The shared part is that of all starts a piece can have, whether this run has them or not.
            last = anchor + base - piece * width
            yield _entries(raw, offs, b.column(0).to_numpy(), lo, hi, anchor + base, (last, last + THRESHOLD - width + 1), buckets, chunk)
            chunk += 1

    rows = open_runs.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi", "anchor")).alias("runs"))
    return texts.select("uid", "text").join(rows, "uid").select("uid", "text", "runs").mapInArrow(rank, BLOCKS)


def repeated_starts(texts: DataFrame) -> DataFrame:
    """(uid, lo, hi): runs of starts whose strings occur earlier."""
    buckets = 2 * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    settled = staged(_first_round(texts, buckets).groupBy("bucket").applyInArrow(_settle, SETTLED), "repeats-0")
    found = settled.where("NOT again")
    for r, width in enumerate(WIDTHS[1:], 1):
        again = _next_round(texts, settled.where("again"), width, buckets)
        settled = staged(again.groupBy("bucket").applyInArrow(_settle, SETTLED), f"repeats-{r}")
        found = found.union(settled.where("NOT again"))
    return found.select("uid", "lo", "hi")


CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (see CUT); ``kept`` is the remaining bytes, undecodable ones replaced.

    A null text is an empty one.  Texts under 100 bytes keep everything.  Rows
    with one doc_id are ordered by text, equal ones arbitrarily: all but the
    first of equal rows lose everything (from 100 bytes on).  Null ids come last.
    """
    texts = bucketed(ordered(docs))
    gone = repeated_starts(texts).groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def cut(batches):
        for b in batches:
            out = []
            for doc_id, text, runs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw, kept, at, removed, spans = text.encode(), [], 0, 0, 0
                for lo, hi in sorted((r["lo"], r["hi"] + THRESHOLD) for r in runs or ()):
                    if lo > at or (lo == at == 0 and not spans):
                        kept.append(raw[at:lo])
                        spans += 1
                        removed += hi - lo
                        at = hi
                    elif hi > at:
                        removed += hi - at
                        at = hi
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((doc_id, len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace")))
            cols = list(zip(*out)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[c.split()[0] for c in CUT.split(", ")])

    return texts.join(gone, "uid", "left").select("doc_id", "text", "runs").mapInArrow(cut, CUT)

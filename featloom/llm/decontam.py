"""Benchmark decontamination with a distributed positional inverted index.

The index holds, for every term of the benchmark, its postings in the corpus
(row, word position), cut into blocks of a few thousand words so that no term is
one row, and one row per document with the term numbers of its words.  A term
that the benchmark lacks cannot be part of a match and gets no postings.

Search: of each 13-word window the rarest terms (by corpus frequency) are looked
up, their postings are shifted by the term's offset in the item, and the shifted
lists are intersected by grouping on (row, item, diagonal).  Rows that survive
are compared word by word, which gives exact phrase matches, and proximity
matches: windows whose rarest terms lie within ``slack`` words of their places.

Only the benchmark (a stated query set) is broadcast, in groups of items of at
most ``MAX_TERMS`` words.  Each group is searched over all documents, and a
document's matches in all groups are put together before it is judged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import ALNUM, ASCII_FOLD, chunks, discard, span_hashes, staged, text_buffer, word_spans

WINDOW = 13
#: Terms of a window whose postings are intersected, rarest first.
RAREST = 3
#: Words by which a rare term may be off in a proximity match.
SLACK = 3
#: Most words of a group of items (8 bytes each on every executor); an item that is longer is a group of its own.
MAX_TERMS = 8_000_000
INDEX = ("kind string, term int, rids array<long>, pos array<int>, "
         "rid long, doc_id long, n_words long, terms binary")


def hashed_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts of a column and the index of each word's text."""
    raw, offs = text_buffer(col)
    s, e, doc = word_spans(raw, offs, ALNUM)
    return span_hashes(raw, s, e, ASCII_FOLD), doc


class Items:
    """The benchmark as arrays: sorted term hashes, and per item its term numbers (from 1)."""

    def __init__(self, rows: list[tuple]) -> None:
        self.ids = [r[0] for r in rows]
        words, item = hashed_words(pa.array([r[1] for r in rows], pa.string()))
        self.vocab, numbers = np.unique(words, return_inverse=True)
        cuts = np.searchsorted(item, np.arange(len(rows) + 1))
        self.words = [numbers[a:z].astype(np.int32) + 1 for a, z in zip(cuts, cuts[1:])]

    def terms_of(self, hashes: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes; 0 for words that no item has."""
        if not len(self.vocab):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, 0).astype(np.int32)

    def windows(self, freq: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per item: the windows' starts, and the positions of the rarest terms of each (windows x r)."""
        out = []
        for w in self.words:
            width = min(WINDOW, len(w))
            if not width:
                out.append((np.empty(0, np.int64), np.empty((0, 0), np.int64)))
                continue
            starts = np.arange(len(w) - width + 1)
            grid = starts[:, None] + np.arange(width)
            order = np.lexsort((grid, freq[w[grid]]), axis=1)[:, :min(RAREST, width)]
            out.append((starts, np.sort(np.take_along_axis(grid, order, 1), 1)))
        return out


def item_groups(benchmark: DataFrame, max_terms: int) -> Iterator[tuple[Items, bool]]:
    """The benchmark in groups of items, each with whether it is the last; the driver holds two groups at most."""
    group, size, ready = [], 0, None
    for item, text in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).toLocalIterator():
        most = len((text or "").encode()) // 2 + 1  # a word takes a byte, and one to part it from the next
        if group and size + most > max_terms:
            if ready is not None:
                yield Items(ready), False
            ready, group, size = group, [], 0
        group.append((item, text))
        size += most
    if ready is not None:
        yield Items(ready), False
    yield Items(group), True


def build_index(docs: DataFrame, items: Items) -> DataFrame:
    """The staged index (see INDEX) of ``docs`` (rid, doc_id, text): ``kind`` posting or doc.  One narrow pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def blocks(batches):
        items = shared.value
        for b in chunks(batches):
            hashes, doc = hashed_words(b.column(2))
            terms = items.terms_of(hashes)
            n_words = np.bincount(doc, minlength=b.num_rows)
            first = np.concatenate([[0], np.cumsum(n_words)])
            rids = b.column(0).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(terms)
            hit = hit[np.argsort(terms[hit], kind="stable")]
            t = terms[hit]
            cut = np.flatnonzero(np.diff(t, prepend=-1))
            offs = pa.array(np.append(cut, len(t)), pa.int32())
            ids, d = pa.array(rids[doc[hit]], pa.int64()), doc[hit]
            pos = pa.array((hit - first[d]).astype(np.int32), pa.int32())
            yield _rows(len(cut), kind="posting", term=pa.array(t[cut], pa.int32()),
                        rids=pa.ListArray.from_arrays(offs, ids), pos=pa.ListArray.from_arrays(offs, pos))
            body = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), b.num_rows, [None, pa.py_buffer(first.astype(np.int64) * 4), pa.py_buffer(terms.tobytes())])
            yield _rows(b.num_rows, kind="doc", rid=pa.array(rids, pa.int64()), doc_id=b.column(1),
                        n_words=pa.array(n_words, pa.int64()), terms=body.cast(pa.binary()))

    return staged(docs.mapInArrow(blocks, INDEX), "postings", ["kind"])


_TYPES = {"kind": pa.string(), "term": pa.int32(), "rids": pa.list_(pa.int64()), "pos": pa.list_(pa.int32()),
          "rid": pa.int64(), "doc_id": pa.int64(), "n_words": pa.int64(), "terms": pa.binary()}


def _rows(n: int, kind: str, **columns) -> pa.RecordBatch:
    cols = {"kind": pa.array([kind] * n, pa.string()), **columns}
    return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(n, t) for c, t in _TYPES.items()], names=list(_TYPES))


def term_frequencies(index: DataFrame, items: Items) -> np.ndarray:
    """Corpus count of every term number (0 for number 0); as many rows as the benchmark has terms."""
    counts = (index.where("kind = 'posting'").groupBy("term").agg(F.sum(F.size("pos")).alias("n"))).toPandas()
    freq = np.zeros(len(items.vocab) + 1, np.int64)
    freq[counts["term"].to_numpy()] = counts["n"].to_numpy()
    return freq


def candidates(index: DataFrame, windows: list, items: Items, slack: int) -> DataFrame:
    """(rid, found): items and diagonal buckets in which enough rare terms of one item meet.

    A term at item position q and document position p lies on diagonal p - q.
    Buckets are slack + 1 wide and overlap by half, so terms within ``slack`` of
    each other share one.
    """
    import pandas as pd  # here, as every Python worker imports this module

    spark, width = index.sparkSession, slack + 1
    rows = [(int(items.words[i][q]), i, int(q), at.shape[1]) for i, (_, at) in enumerate(windows) for q in np.unique(at)]
    anchors = spark.createDataFrame(pd.DataFrame(rows, columns=["term", "item", "q", "need"]).astype("int32")
                                    if rows else [], "term int, item int, q int, need int")
    hits = (index.where("kind = 'posting'").select("term", "rids", "pos").join(F.broadcast(anchors), "term")
            .select("item", "q", "need", F.explode(F.arrays_zip("rids", "pos")).alias("p"))
            .select("item", "q", "need", F.col("p.rids").alias("rid"), (F.col("p.pos") - F.col("q")).alias("diag")))
    bucket = F.floor(F.col("diag") / width).cast("int")
    met = (hits.select("rid", "item", "need", "q", F.explode(F.array(bucket, bucket - 1)).alias("bucket")).distinct()
           .groupBy("rid", "item", "need", "bucket").agg(F.count("*").alias("n")).where("n >= need"))
    return met.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("item", "bucket"))).alias("found"))


MATCH = "rid long, item string, size int, starts array<int>, near boolean"


def match(index: DataFrame, found: DataFrame, windows: list, items: Items, slack: int) -> DataFrame:
    """(rid, item, size, starts, near): word positions where windows of the item, ``size`` words each, occur, and whether one is near."""
    names = [i if i is not None else "null" for i in items.ids]
    shared = index.sparkSession.sparkContext.broadcast((names, items.words, windows))
    width = slack + 1

    def compare(batches):
        names, words, windows = shared.value
        for b in batches:
            out = []
            for rid, raw, pairs in zip(*(b.column(i).to_pylist() for i in range(3))):
                terms = np.frombuffer(raw, np.int32)
                by_item: dict[int, list[int]] = {}
                for p in pairs:
                    by_item.setdefault(p["item"], []).append(p["bucket"])
                for i, buckets in by_item.items():
                    starts, near = _occurrences(terms, words[i], windows[i], buckets, width)
                    if len(starts) or near:
                        out.append((rid, names[i], min(WINDOW, len(words[i])), starts, near))
            cols = list(zip(*out)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["rid", "item", "size", "starts", "near"])

    docs = index.where("kind = 'doc'").select("rid", "terms")
    return docs.join(found, "rid").select("rid", "terms", "found").mapInArrow(compare, MATCH)


def _occurrences(doc: np.ndarray, item: np.ndarray, window: tuple, buckets: list[int], width: int) -> tuple[list[int], bool]:
    starts, at = window
    size, found, near = min(WINDOW, len(item)), set(), False
    rare = np.unique(at)
    for bucket in buckets:
        diags = bucket * width + np.arange(2 * width)
        places = rare[:, None] + diags
        inside = (places >= 0) & (places < len(doc))
        here = np.zeros(places.shape, bool)
        here[inside] = (doc[places.clip(0, max(len(doc) - 1, 0))] == item[rare][:, None])[inside]
        pos = np.searchsorted(rare, at)
        if not near:
            reach = np.stack([here[:, d:d + width].any(1) for d in range(width + 1)], 1)
            near = bool(reach[pos].all(1).any())
        for k in np.flatnonzero(here[pos].all(1).any(0)):
            d = int(diags[k])
            lo, hi = max(0, -d), min(len(item), len(doc) - d)
            if hi - lo < size:
                continue
            same = np.concatenate([[0], np.cumsum(doc[lo + d:hi + d] == item[lo:hi])])
            found.update((np.flatnonzero(same[size:] - same[:-size] == size) + lo + d).tolist())
    return sorted(found), near


def search(docs: DataFrame, benchmark: DataFrame, slack: int, max_terms: int) -> tuple[DataFrame, DataFrame]:
    """An index of ``docs`` and the matches (see MATCH) of all items; one pass over ``docs`` per group of items."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    index, found = None, []
    for items, last in item_groups(benchmark, max_terms):
        if index is None and not last:
            rows = staged(rows, "decontamination-texts")  # every group meets the same row ids
        here = build_index(rows, items)
        windows = items.windows(term_frequencies(here, items))
        hits = match(here, candidates(here, windows, items, slack), windows, items, slack)
        if index is None and last:
            return here, hits
        found.append(staged(hits, "matches"))
        if index is None:
            index = here
        else:
            discard(here)
    discard(rows)
    return index, reduce(DataFrame.union, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, slack: int = SLACK, max_terms: int = MAX_TERMS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts of hit words and matched items.

    A null or empty text has no words and is clean.  An item without words has no
    windows.  Items are told apart by item_id, so repeated items count once (a
    null id is one id).  Repeated documents are judged row by row.  ``max_terms``
    bounds the words of the items that are searched at once, not the result.
    """
    index, matches = search(docs, benchmark, slack, max_terms)

    def per_row(batches):
        for b in batches:
            out = []
            for rid, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ends, covered = -1, 0
                for s, e in sorted((s, s + f["size"]) for f in found for s in f["starts"]):
                    covered += max(0, e - max(s, ends))
                    ends = max(ends, e)
                exact = sorted({f["item"] for f in found if f["starts"]})
                near = {f["item"] for f in found}
                out.append((rid, covered, len(exact), hashlib.sha256(",".join(exact).encode()).hexdigest(), len(near)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            cols = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             names=["rid", "n_hit", "n_items", "items_sha256", "n_near_items"])

    verdict = (matches.groupBy("rid").agg(F.collect_list(F.struct("item", "size", "starts")).alias("found"))
               .mapInArrow(per_row, "rid long, n_hit long, n_items long, items_sha256 string, n_near_items long"))
    zero = F.lit(0).cast("long")
    return (index.where("kind = 'doc'").select("rid", "doc_id", "n_words").join(verdict, "rid", "left")
            .select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
                    F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"),
                    F.coalesce("n_near_items", zero).alias("n_near_items"))
            .withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))))

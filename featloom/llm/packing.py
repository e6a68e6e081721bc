"""Lexical retrieval packing: BM25 neighbours fill each seed document's window.

Documents are tokenised once into a staged table of token ids.  Term statistics
(document frequencies, mean length) cover all documents.  The BM25 inverted
index is sharded by topic: documents of like vocabulary, whatever file they come
from, meet in a shard of about ``SHARD_TARGET`` documents, which bounds a task's
memory; neighbours in other shards are not found.  Topics are fitted on a sample of
``SAMPLE`` documents; a large topic is cut into shards along a random direction, so
near copies stay together, and copies too many for one shard are dealt out.  Whole
windows of a long document are sequences of their own; the ends of documents are
packed: a seed asks its shard's index, with all terms of its whole document, for
unused neighbours, whose ends fill its window in order of score.  The neighbour that
does not fit is cut, and its rest is the next seed, so only the last sequence of a
shard is padded.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import chunks, span_hashes, staged, text_buffer

WINDOW = 1024
#: Mean and largest number of documents of a shard.
SHARD_TARGET, SHARD_DOCS = 1800, 2048
#: Topics, the terms that tell them apart, documents they are fitted on, and steps of the fit.
TOPICS, TERMS, SAMPLE, STEPS = 64, 2048, 4096, 8
#: BM25 parameters.
K1, B = 1.2, 0.75
END = 0
SPECIAL = {"<|endoftext|>": 50256}
#: Segments whose ids a Python worker remembers before it starts anew, and ids: without spaces a segment is a text.
CACHE_SEGMENTS, CACHE_IDS = 1_000_000, 1 << 23
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, ids binary")


class Segments:
    """Token ids of text by segments that pre-tokenisation never joins.

    A segment begins at a space after a visible character (no token of the
    vocabulary's pattern spans that border).  Distinct segments are encoded once
    per worker and gathered by 64-bit hash.
    """

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=SPECIAL)
        self.bytes_of = np.zeros(1 << 16, np.int64)
        for token, i in [*ranks.items(), *((k.encode(), v) for k, v in SPECIAL.items())]:
            self.bytes_of[i] = len(token)
        self.clear(CACHE_SEGMENTS)

    def clear(self, room: int) -> None:
        """Forgets all segments and makes room for the given number of them, in an open hash table of twice that."""
        size = 1 << (2 * room - 1).bit_length()
        self.room, self.mask = room, np.uint64(size - 1)
        self.slot_key, self.slot_at = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.at, self.n, self.flat = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint16)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each segment, -1 if it isn't known."""
        out, open_, place = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), hashes & self.mask
        while len(open_):
            at = self.slot_at[place]
            hit = (at >= 0) & (self.slot_key[place] == hashes[open_])
            out[open_[hit]] = at[hit]
            on = (at >= 0) & ~hit
            open_, place = open_[on], (place[on] + np.uint64(1)) & self.mask
        return out

    def _enter(self, hashes: np.ndarray) -> None:
        """Gives distinct new segments the next numbers."""
        left = np.arange(len(hashes))
        place, number = hashes & self.mask, (len(self.at) + left).astype(np.int32)
        while len(left):
            free = self.slot_at[place] < 0
            self.slot_at[place[free]] = number[left[free]]
            won = free & (self.slot_at[place] == number[left])
            self.slot_key[place[won]] = hashes[left[won]]
            left, place = left[~won], (place[~won] + np.uint64(1)) & self.mask

    @staticmethod
    def borders(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Start of every segment: of each text, and each space that opens one."""
        visible = (raw > 32) & (raw < 127)
        cut = np.zeros(len(raw), bool)
        cut[1:-1] = raw[1:-1] == 32
        cut[1:-1] &= visible[:-2] | ((raw[:-2] > 127) & visible[2:])
        cut[offs[:-1][offs[:-1] < offs[1:]]] = True
        return np.flatnonzero(cut)

    def learn(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray, new: np.ndarray) -> None:
        """Encodes distinct segments, none of them known.

        Segments that open with a space and whose neighbours in a row of them keep the borders are
        encoded as one text: first those that end with a visible character, whatever follows the
        space, then those with a visible character after the space, whose ends may be non-ASCII.  The
        others (at the starts of texts, or non-ASCII at both ends) are encoded one by one.
        """
        last, second = raw[e - 1], raw[np.minimum(s + 1, len(raw) - 1)]
        opens = (raw[s] == 32) & (e - s > 1)
        ascii_end, ascii_start = (last > 32) & (last < 127), (second > 32) & (second < 127)
        then = opens & ascii_start & (ascii_end | (last > 127))
        before = opens & ~then & ascii_end & (second > 127)
        order = np.concatenate([np.flatnonzero(before), np.flatnonzero(then), np.flatnonzero(~before & ~then)])
        new, s, e = new[order], s[order], e[order]
        k, data = int((before | then).sum()), raw.tobytes()
        text = b"".join([data[a:z] for a, z in zip(s[:k].tolist(), e[:k].tolist())])
        ids = np.array(self._ids(text), np.uint16)
        if self.bytes_of[ids].sum() != len(text):  # no UTF-8
            ids, k = ids[:0], 0
        ends = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum((e - s)[:k]))
        n = np.diff(ends + 1, prepend=0)
        rest = [self._ids(data[a:z]) for a, z in zip(s[k:].tolist(), e[k:].tolist())]
        n = np.concatenate([n, np.fromiter(map(len, rest), np.int64, len(rest))])
        flat = np.concatenate([ids, np.fromiter((x for i in rest for x in i), np.uint16)])
        self._enter(new)
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(n) - n])
        self.n, self.flat = np.concatenate([self.n, n]), np.concatenate([self.flat, flat])

    def _ids(self, text: bytes) -> list[int]:
        return self.encoding.encode(text.decode("utf-8", "replace"), allowed_special="all")

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and the n+1 offsets."""
        s = self.borders(raw, offs)
        e = np.append(s[1:], len(raw))
        hashes = span_hashes(raw, s, e)
        k = self.find(hashes)
        missing = np.flatnonzero(k < 0)
        if len(missing):
            distinct, first = np.unique(hashes[missing], return_index=True)
            if len(self.at) + len(distinct) > self.room or len(self.flat) > CACHE_IDS:
                self.clear(max(CACHE_SEGMENTS, len(hashes)))
                missing = np.arange(len(hashes))
                distinct, first = np.unique(hashes, return_index=True)
            new = missing[first]
            self.learn(raw, s[new], e[new], distinct)
            k[missing] = self.find(hashes[missing])
        doc = np.searchsorted(offs, s, side="right") - 1
        n = self.n[k]
        per_doc = np.bincount(doc, n, len(offs) - 1).astype(np.int64) + 1
        ends = np.cumsum(per_doc)
        out = np.full(ends[-1] if len(ends) else 0, END, np.uint16)
        place = np.cumsum(n) - n + doc
        index = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(place, n) + index] = self.flat[np.repeat(self.at[k], n) + index]
        return out, np.concatenate([[0], ends])


@lru_cache(maxsize=1)
def _segments(ranks_path: str, pattern: str) -> Segments:
    """The segments of this Python worker; they outlive a task."""
    return Segments(ranks_path, pattern)


def tokenize(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Staged (doc_id, ids): little-endian unsigned 16-bit ids of each document, its end id included."""

    def run(batches):
        from featloom.llm import packing  # the worker's own module, whose cache outlives the task

        enc = packing._segments(ranks_path, pattern)
        for b in chunks(batches):
            ids, offs = enc.encode(*text_buffer(b.column(1)))
            col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offs * 2), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([b.column(0), col.cast(pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return staged(rows.mapInArrow(run, "doc_id long, ids binary"), "token-ids")


def statistics(tokens: DataFrame) -> tuple[np.ndarray, int, float]:
    """Document frequency of every id, number of documents, mean length: over all documents."""

    def count(batches):
        df, n, total = np.zeros(1 << 16, np.int64), 0, 0
        for b in chunks(batches, col="ids"):
            ids, offs = _ids(b)
            key = (np.repeat(np.arange(b.num_rows, dtype=np.uint64), np.diff(offs)) << np.uint64(16)) | ids
            key.sort()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            df += np.bincount((key[new] & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            n, total = n + b.num_rows, total + len(ids)
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hit, [-1, -2]), pa.int64()), pa.array(np.append(df[hit], [n, total]), pa.int64())],
                                         names=["id", "n"])

    sums = tokens.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    got = {r["id"]: r["n"] for r in sums}
    n, total = got.pop(-1, 0), got.pop(-2, 0)
    df = np.zeros(1 << 16, np.int64)
    for k, v in got.items():
        df[k] = v
    return df, n, total / max(n, 1)


def presence(ids: np.ndarray, offs: np.ndarray, column: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` 0/1 flags per document: which of the chosen terms it holds."""
    out = np.zeros((len(offs) - 1, width + 1), np.float32)
    out[np.repeat(np.arange(len(offs) - 1), np.diff(offs)), column[ids]] = 1
    return out[:, :width]


def _ids(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = text_buffer(b.column(b.schema.get_field_index("ids")))
    return raw.view(np.uint16) if len(raw) else np.empty(0, np.uint16), offs // 2


class Topics:
    """Places documents on the line [0, 1): topics in a row, like ones side by side, each as long as its share.

    Within its topic a document's place is the quantile of its terms' random projection.
    """

    def __init__(self, flags: np.ndarray, weight: np.ndarray) -> None:
        rng = np.random.default_rng(1024)
        x = flags * weight
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        k = max(1, min(TOPICS, len(x)))
        centre = x[rng.choice(len(x), k, replace=False)] if len(x) else np.zeros((1, len(weight)), np.float32)
        for _ in range(STEPS if len(x) else 0):
            own = (x @ centre.T).argmax(1)
            centre = np.eye(k, dtype=np.float32)[own].T @ x
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
        near, chain = centre @ centre.T, [0]
        while len(chain) < k:
            chain.append(max(set(range(k)) - set(chain), key=lambda j: (near[chain[-1], j], -j)))
        centre = centre[chain]
        spread = rng.normal(size=len(weight))
        self.matrix = np.column_stack([(centre * weight).T, weight * spread, weight * weight]).astype(np.float32)
        topic, at = self._project(flags)
        share = np.bincount(topic, minlength=k) / max(len(x), 1)
        self.start = np.concatenate([[0], np.cumsum(share)])
        self.values = [np.sort(at[topic == t]) for t in range(k)]

    def _project(self, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = flags @ self.matrix
        return p[:, :-2].argmax(1), np.round(p[:, -2] / np.sqrt(np.maximum(p[:, -1], 1e-9)), 3)

    def place(self, flags: np.ndarray, jitter: np.ndarray) -> np.ndarray:
        """Place of every document; ``jitter`` in [0, 1) spreads those that many sampled documents equal."""
        topic, at = self._project(flags)
        out = np.empty(len(flags))
        for t in np.unique(topic):
            here, v = topic == t, self.values[t]
            lo, hi = np.searchsorted(v, at[here]), np.searchsorted(v, at[here], side="right")
            u = np.interp(at[here], v, np.arange(len(v)) + 0.5) if len(v) else jitter[here]
            many = hi - lo > 2
            u[many] = (lo + jitter[here] * (hi - lo))[many]
            out[here] = self.start[t] + u / max(len(v), 1) * (self.start[t + 1] - self.start[t])
        return np.clip(out, 0, np.nextafter(1, 0))


def topics(tokens: DataFrame, df: np.ndarray, n: int, idf: np.ndarray) -> tuple[Topics, np.ndarray]:
    """Topics of a sample of at most ``SAMPLE`` documents, and the column of each term (``TERMS`` if it has none)."""
    told = np.where(2 * df <= n, df * idf * idf, 0)
    chosen = np.argsort(-told, kind="stable")[:TERMS]
    column = np.full(1 << 16, TERMS, np.int64)
    column[chosen] = np.arange(TERMS)

    def flags(batches):
        for b in chunks(batches, col="ids"):
            bits = np.packbits(presence(*_ids(b), column, TERMS).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in bits], pa.binary())], names=["bits"])

    rows = tokens.select("ids").sample(min(1.0, SAMPLE / max(n, 1)), seed=1024).limit(SAMPLE).mapInArrow(flags, "bits binary").collect()
    bits = np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1 if rows else TERMS // 8)
    return Topics(np.unpackbits(bits, axis=1).astype(np.float32), (idf * (told > 0))[chosen].astype(np.float32)), column


class Shard:
    """A BM25 inverted index over whole documents, and the greedy filling of windows with their open ends.

    ``left`` is how many ids of each document are still to be packed.  Terms that
    more than a quarter of the documents have are dense rows, the others postings.
    """

    def __init__(self, docs: list[np.ndarray], left: np.ndarray, idf: np.ndarray, mean: float) -> None:
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        terms, counts = zip(*(np.unique(x, return_counts=True) for x in docs))
        size = np.fromiter(map(len, terms), np.int64, len(docs))
        d, t, tf = np.repeat(np.arange(len(docs)), size), np.concatenate(terms).astype(np.int64), np.concatenate(counts)
        w = (idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[d] / mean))).astype(np.float32)
        df = np.bincount(t, minlength=1 << 16)
        often = 4 * df > len(docs)
        row = np.cumsum(often) - 1
        here = often[t]
        self.dense = np.zeros((int(often.sum()), len(docs)), np.float32)
        self.dense[row[t[here]], d[here]] = w[here]
        order = np.flatnonzero(~here)
        order = order[np.argsort(t[order], kind="stable")]
        self.docs, self.weights = d[order], w[order]
        self.bounds = np.searchsorted(t[order], np.arange((1 << 16) + 1))
        first = np.cumsum(size) - size
        self.query = []
        for a, n in zip(first.tolist(), size.tolist()):
            own = t[a:a + n]
            own = own[df[own] > 1]  # a term of the seed alone scores nobody else
            self.query.append((row[own[often[own]]], own[~often[own]]))
        self.left = left.copy()

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for all terms of the seed."""
        rows, rare = self.query[seed]
        a, n = self.bounds[rare], self.bounds[rare + 1] - self.bounds[rare]
        at = np.arange(int(n.sum())) + np.repeat(a - (np.cumsum(n) - n), n)
        return np.bincount(self.docs[at], self.weights[at], len(self.left)) + self.dense[rows].sum(0)

    def neighbours(self, seed: int) -> np.ndarray:
        """Unused documents in order of BM25 score for the seed, whole document against whole document."""
        score = self.scores(seed)
        open_ = np.flatnonzero(self.left > 0)
        return open_[np.argsort(-score[open_], kind="stable")]

    def sequences(self):
        """Lists of (document, length) that fill a window each; a document's pieces come in order."""
        seed, n_open, at = 0, int((self.left > 0).sum()), 0
        while n_open:
            while self.left[at] == 0:
                at += 1
            if self.left[seed] == 0:
                seed = at
            room, out = WINDOW, []
            order = np.array([seed])
            if self.left[seed] < room and n_open > 1:
                others = self.neighbours(seed)
                order = np.append(order, others[others != seed])
            for x in map(int, order):  # a window takes a few of them
                n = int(min(room, self.left[x]))
                out.append((x, n))
                self.left[x] -= n
                room -= n
                if self.left[x] == 0:
                    n_open -= 1
                else:
                    seed = x
                if not room:
                    break
            yield out


def pack(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Pieces (see PIECES) of every row of ``docs``; a sequence holds at most 1024 ids.

    A null or empty text is its end id alone.  Repeated rows are packed as often
    as they occur.  Sequence ids are unique; offsets within one are gapless.
    """
    tokens = tokenize(docs, ranks_path, pattern)
    df, n, mean = statistics(tokens)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    n_shards = -(-n // SHARD_TARGET)
    shared = docs.sparkSession.sparkContext.broadcast((idf, mean, *topics(tokens, df, n, idf)))

    def place(batches):
        _, _, line, column = shared.value
        row = TaskContext.get().partitionId()
        for b in chunks(batches, col="ids"):
            for at in range(0, b.num_rows, 1024):
                c = b.slice(at, 1024)
                row += c.num_rows
                jitter = (row - np.arange(c.num_rows)) * 0.6180339887498949 % 1
                shard = (line.place(presence(*_ids(c), column, TERMS), jitter) * n_shards).astype(np.int64)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(shard)], names=["doc_id", "ids", "shard"])

    def run(batches):
        idf, mean, _, _ = shared.value
        number = TaskContext.get().partitionId() << 36

        def emit(pieces):
            cols = list(zip(*pieces))
            types = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                              names=[c.strip().split()[0] for c in PIECES.split(",")])

        def piece(doc, start, n, sequence, offset):
            doc_id, ids = doc
            part = ids[start:start + n].astype("<u4").tobytes()
            return doc_id, start, n, zlib.crc32(part), len(ids), sequence, offset, part

        def packed(shard):
            nonlocal number
            whole = [len(ids) // WINDOW * WINDOW for _, ids in shard]
            pieces = []
            for doc, w in zip(shard, whole):
                for start in range(0, w, WINDOW):
                    pieces.append(piece(doc, start, WINDOW, number, 0))
                    number += 1
                    if len(pieces) >= 4096:
                        yield emit(pieces)
                        pieces = []
            rest = [i for i, (_, ids) in enumerate(shard) if len(ids) > whole[i]]
            if rest:
                at = {k: whole[i] for k, i in enumerate(rest)}
                left = np.array([len(shard[i][1]) - whole[i] for i in rest])
                for row in Shard([shard[i][1] for i in rest], left, idf, mean).sequences():
                    offset = 0
                    for k, n in row:
                        pieces.append(piece(shard[rest[k]], at[k], n, number, offset))
                        at[k] += n
                        offset += n
                    number += 1
            if pieces:
                yield emit(pieces)

        shard, held, now = [], 0, None
        for b in chunks(batches, col="ids"):
            for doc_id, raw, key in zip(*(c.to_pylist() for c in b.columns)):
                if shard and (key != now or len(shard) >= SHARD_DOCS or held >= 64 << 20):
                    yield from packed(shard)
                    shard, held = [], 0
                shard.append((doc_id, np.frombuffer(raw, np.uint16)))
                held, now = held + len(raw), key
        if shard:
            yield from packed(shard)

    placed = tokens.mapInArrow(place, "doc_id long, ids binary, shard long")
    return placed.repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(run, PIECES)

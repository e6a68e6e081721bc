"""Shared pieces of the training-data operators: staged tables and byte-level hashing.

The numpy helpers work on one Arrow batch at a time: all texts of the batch are
one byte buffer, so word spans, word hashes and n-gram hashes come out of a few
vectorised passes and memory is bounded by the batch.
"""

from __future__ import annotations

import uuid
import weakref
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.session import checkpoint_dir, delete_path

ASCII_SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Deletes the shuffle files of an execution as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a Bloom filter for each key, and at most (8 MB).
BLOOM_BITS, BLOOM_MOST = 16, 1 << 26
#: Keys up to which a staged table of them is broadcast.
BROADCAST_KEYS = 1_000_000
#: Bytes of an Arrow batch that goes to a Python worker: by rows alone it grows with their length.
BATCH_BYTES = 4 << 20
#: Short rows (ids and numbers) that a file of a staged table has on average at least, if its tasks allow.
FILE_ROWS = 1 << 18
#: Where staged tables lie, and the folders of every open scope.
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
_SCOPES: list[list[str]] = []


def staging_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, removed with its scope or when the session's JVM ends."""
    path = f"{checkpoint_dir(spark)}/llm-{name}-{uuid.uuid4().hex[:12]}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    for scope in _SCOPES:
        scope.append(path)
    return path


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None, conf: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that survives lost executors.

    What the write has shuffled is deleted with it: from here on the table stands for it.
    Python workers get batches of ``BATCH_BYTES``.  ``conf`` holds during the write.
    """
    spark, path = df.sparkSession, staging_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    conf = {_CLEANUP: "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES), **(conf or {})}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def bloom(n: int) -> dict[str, str]:
    """Settings under which a shuffle join first drops rows by Spark's Bloom filter over the other side's ``n`` keys.

    That side needs a filter of its own, or Spark doesn't expect it to leave out any.
    """
    of = "spark.sql.optimizer.runtime.bloomFilter."
    n = max(n, 1)
    bits = str(min(max(BLOOM_BITS * n, 1 << 10), BLOOM_MOST))
    return {f"{of}enabled": "true", f"{of}applicationSideScanSizeThreshold": "0", f"{of}creationSideThreshold": str(1 << 40),
            f"{of}expectedNumItems": str(n), f"{of}maxNumItems": str(n), f"{of}numBits": bits, f"{of}maxNumBits": bits}


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which has about ``rows`` short rows, in as many partitions as these fill, but one for every core.

    A file costs an executor the same however few rows it has: on a local disk Hadoop starts two processes for it.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def without(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key isn't in the staged table ``keys``; they are shuffled only if it has too many to broadcast."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, on, "left_anti")


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing reads any more."""
    for t in tables:
        delete_path(t.sparkSession, _PATHS.pop(t))


@contextmanager
def staging_scope(folders: list[str] | None = None):
    """Collects the folders staged inside; see ``discard_folders``."""
    folders = [] if folders is None else folders
    _SCOPES.append(folders)
    try:
        yield folders
    finally:
        _SCOPES.remove(folders)


def discard_folders(spark: SparkSession, folders: list[str], keep: DataFrame | None = None) -> None:
    """Deletes the folders of a scope, but for that of the staged table ``keep``."""
    for path in folders:
        if keep is None or path != _PATHS[keep]:
            delete_path(spark, path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


# --- byte-level helpers (numpy) ------------------------------------------------

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
#: Bytes of which ``span_hashes`` holds 8-byte sums at once.
HASH_BLOCK = 1 << 17


def _inverse(odd: np.uint64) -> np.uint64:
    return _U(pow(int(odd), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class _PowerTable:
    """Powers of the hash base and of its inverse, grown to the longest batch seen."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_BASE, n), _powers(_inverse(_BASE), n)
        return self.up, self.down


_TABLE = _PowerTable()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising bit mixer (in place on a fresh array)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column and the n+1 offsets; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    col = col.cast(pa.large_binary()).fill_null(b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def chunks(batches, max_bytes: int = 2 << 20, col: str = "text"):
    """Slices of the incoming record batches of about ``max_bytes`` of text (one long text stays whole)."""
    for b in batches:
        lens = _lengths(b.column(b.schema.get_field_index(col)))
        at = 0
        while at < b.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(lens[at:]), max_bytes)))
            yield b.slice(at, n)
            at += n


def _lengths(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def word_spans(raw: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document index of every maximal run of ``is_word`` bytes; runs never cross documents."""
    if not len(raw):
        e = np.empty(0, np.int64)
        return e, e, e
    inside = is_word[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offs[:-1][(offs[:-1] < offs[1:])]
    begins[first] = inside[first]
    ends[first[1:] - 1] = inside[first[1:] - 1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def span_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (``fold`` maps bytes first, e.g. to lower case).

    Spans ascend and don't overlap.  Bytes are hashed ``HASH_BLOCK`` at a time, so that a worker
    keeps no 8-byte arrays as long as its longest text; a span is the sum of its parts in each block.
    """
    table = _BYTE if fold is None else _BYTE[fold]
    up, down = _TABLE.get(min(len(raw), HASH_BLOCK) + 1)
    out, pre = (e - s).astype(np.uint64) * _STEP, np.zeros(min(len(raw), HASH_BLOCK) + 1, np.uint64)
    for at in range(0, len(raw), HASH_BLOCK):
        part = raw[at:at + HASH_BLOCK]
        i, j = np.searchsorted(e, at, side="right"), np.searchsorted(s, at + len(part))
        if i < j:
            np.cumsum(table[part] * up[:len(part)], out=pre[1:len(part) + 1])
            lo, hi = np.maximum(s[i:j] - at, 0), np.minimum(e[i:j] - at, len(part))
            sums = (pre[hi] - pre[lo]) * down[lo]
            if s[i] < at:  # only the first may have begun in an earlier block
                sums[:1] *= _U(pow(int(_BASE), int(at - s[i]), 1 << 64))
            out[i:j] += sums
    return mix(out)


ASCII_FOLD = np.arange(256, dtype=np.uint8)
ASCII_FOLD[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, *range(9, 14)]] = False
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = np.ones(256, bool)
ALNUM[:128] = False
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out *= _STEP
        out += words[j:j + m]
    return mix(out)

"""Line dedup over levelled sorted runs of line hashes (built-in functions only).

Documents arrive in batches of ascending ``doc_id``.  The line hashes seen so
far are kept as sorted runs (bucketed, sorted tables), newest at level 0; when a
level holds ``fanout`` runs they are merged into one run of the next level.  A
batch is joined against one run after the other, bucket to bucket: a key found
there belongs to an earlier document, a key that is new belongs to the smallest
``doc_id`` of the batch and is added as the batch's own run.  A run is shuffled
and sorted when it is first written and never again: looking keys up in it and
merging it read its buckets in the order they were written in.  Only (hash, id,
position) rows are shuffled; texts move once, to meet the positions that they lose.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm.common import ASCII_SPACE, discard, lower_ascii, staged, staging_path, text_or_empty
from featloom.session import delete_path

MIN_KEY_CHARS = 10
#: A null id comes after every other id.
NO_ID = 2**63 - 1
#: Whether a scan of a bucketed table may report the order of its buckets' files.
_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def stored_order(spark: SparkSession):
    """Scans of runs rely on the order inside a bucket: every bucket of a run is one file, sorted when written."""
    before = spark.conf.get(_ORDER)
    spark.conf.set(_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(_ORDER, before)


class LineRuns:
    """The levelled runs; each run is a table of line hashes ``h1, h2``, bucketed and sorted by them."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fanout: int = 2) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}

    def _write(self, keys: DataFrame) -> str:
        """A run of ``keys``, which lie in the runs' buckets; one task per bucket, so one sorted file per bucket."""
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        self.paths[name] = staging_path(self.spark, name)
        with stored_order(self.spark):
            (keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2")
             .option("path", self.paths[name]).saveAsTable(name))
        return name

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def mark_seen(self, keys: DataFrame) -> DataFrame:
        """``keys`` (h1, h2, ...; each once) with ``seen``: whether any run holds the key.

        Only ``keys`` are dealt to the buckets and sorted; to be run under ``stored_order``.
        """
        marks = []
        for i, run in enumerate(self.tables()):
            marks.append(f"_run{i}")
            keys = keys.join(run.withColumn(marks[-1], F.lit(True)).hint("merge"), ["h1", "h2"], "left")
        return keys.withColumn("seen", F.coalesce(*marks, F.lit(False))).drop(*marks)

    def add(self, keys: DataFrame) -> None:
        """Add a batch's own keys as a level-0 run; merge each level that is full into the next."""
        self._put(0, self._write(keys.repartition(self.buckets, "h1", "h2")))

    def _put(self, level: int, table: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.fanout:
            runs, self.levels[level] = self.levels[level], []
            self._put(level + 1, reduce(self._merge, runs))

    def merged(self, a: str, b: str) -> DataFrame:
        """All keys of two runs, which share none: a merge of bucket with bucket."""
        return self.spark.table(a).join(self.spark.table(b).hint("merge"), ["h1", "h2"], "full")

    def _merge(self, a: str, b: str) -> str:
        out = self._write(self.merged(a, b))
        self._drop(a)
        self._drop(b)
        return out

    def drop(self) -> None:
        for level in self.levels:
            for t in level:
                self._drop(t)
        self.levels = []

    def _drop(self, table: str) -> None:
        """Drops a run and its files, which an external table would leave."""
        self.spark.sql(f"DROP TABLE {table}")
        delete_path(self.spark, self.paths.pop(table))


def line_keys(docs: DataFrame) -> DataFrame:
    """(did, th, pos, h1, h2): 128-bit hash of every line key that takes part."""
    line = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("did"), text_or_empty().alias("t")).select(
        "did", F.xxhash64("t").alias("th"), F.posexplode(F.split("t", "\n", -1)).alias("pos", "line"))
    key = lower_ascii(F.btrim("line", F.lit(ASCII_SPACE)))
    return (line.select("did", "th", "pos", key.alias("key")).where(F.length("key") >= MIN_KEY_CHARS)
            .select("did", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("2"), F.col("key")).alias("h2")))


def dedup_batch(docs: DataFrame, runs: LineRuns, last: bool = False) -> DataFrame:
    """Positions that the batch's documents lose: (did, th, pos).  Adds the batch's new keys to ``runs``."""
    keys = staged(line_keys(docs), "line-keys")
    own = runs.mark_seen(keys.groupBy("h1", "h2").agg(F.min("did").alias("owner")))
    with stored_order(docs.sparkSession):
        own = staged(own, "line-owners")
    lost = (keys.join(own, ["h1", "h2"]).where(F.col("seen") | (F.col("owner") < F.col("did")))
            .select("did", "th", "pos"))
    lost = staged(lost, "lines-lost")
    if not last:
        runs.add(own.where(~F.col("seen")).select("h1", "h2"))
    discard(keys, own)
    return lost


def dedup(docs: DataFrame, batches: int = 4) -> DataFrame:
    """``docs`` with ``text`` reduced to the kept lines, plus ``n_lines`` and ``n_dropped``.

    Keys shorter than 10 characters stay.  A null or empty text is one empty
    line.  Rows that share a doc_id count as one document; a null doc_id sorts
    last.  A document keeps its own repeats of a line that it owns.  Input
    columns named like computed ones are replaced.
    """
    spark = docs.sparkSession
    did = F.coalesce("doc_id", F.lit(NO_ID))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 100_000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    runs, lost = LineRuns(spark), []
    for i in range(len(cuts) + 1):
        part = docs
        if i > 0:
            part = part.where((F.col("doc_id") > cuts[i - 1]) | (F.col("doc_id").isNull() if i == len(cuts) else F.lit(False)))
        if i < len(cuts):
            part = part.where(F.col("doc_id") <= cuts[i])
        lost.append(dedup_batch(part, runs, last=i == len(cuts)))
    runs.drop()
    gone = reduce(DataFrame.union, lost).groupBy("did", "th").agg(F.collect_set("pos").alias("_gone"))
    keep = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    lines = F.split("_t", "\n", -1)
    # The input's columns travel in one struct, so that none of them meets a helper column.
    out = (docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_in"), did.alias("did"), text_or_empty().alias("_t"))
           .withColumn("th", F.xxhash64("_t")).join(gone, ["did", "th"], "left"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(_l) - 1), _gone), i -> _l[i]), '\n')")
    return (out.withColumn("_l", lines)
            .select("_in.*", F.when(F.col("_gone").isNull(), F.col("_t")).otherwise(kept).alias("text"),
                    F.size("_l").cast("long").alias("n_lines"),
                    F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped")))


ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
d AS (SELECT k.doc_id, k.pos, k.line, o.owner IS NOT NULL AND o.owner < k.doc_id AS dropped
      FROM k LEFT JOIN o ON length(k.key) >= 10 AND k.key = o.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, sum(dropped::INT)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""

"""Merkle manifest of a dataset by time-forward processing.

Each row is a leaf: the SHA-256 of its fields.  The leaves of a source form a tree
in the order of their ids, three children to a node; the subroots form one more
tree in the order of the sources.  Every digest is a message to its parent.

* The queue: messages are rows labelled ``(tree, block, pos)`` and ordered by
  Spark's external sort (shuffle by block, sort within partitions).  A task reads
  them in label order, so all children of a node lie side by side when its time
  comes, and holds one block of at most ``3 ** HEIGHT`` nodes.  A block passes
  through its ``HEIGHT`` levels and sends its top digest on to the next epoch's
  queue; a tree of n leaves takes about ``log(n) / log(2187)`` epochs.
* The reversed sweep: from the root down, each block receives one message that
  sorts before its nodes, the rest of the path from the block's top to the root.
  The task rebuilds the block's levels and hands every node the siblings on its
  way up, followed by that rest.  Only block tops and leaves are ever stored.

Positions come from a range sort with one count per partition on the driver; a
source that holds a third of all rows is many partitions and many blocks.

A proof is a text: the levels from the leaf to the root, separated by ``/``, each
as ``left:right`` (the digests of the siblings before and after, concatenated; both
empty for an only child).  No level at all is an empty proof.

Rows: a null field counts as ``-``; a null source is a source of its own, the first;
rows with equal ids are ordered by digest, null ids first; equal rows are leaves
each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import staged
from featloom.llm.lang_id import CRC32_SQL

HEIGHT = 7
WIDTH = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 over ``-`` for a null, else byte count, ``:`` and the value as text."""
    text = [c.cast("string") for c in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in text]), 256)


def tree_key(source: Column) -> Column:
    """Sorts the null source first and the others by their bytes."""
    return F.coalesce(F.concat(F.lit("1"), source.cast("string")), F.lit("0"))


# --- positions -------------------------------------------------------------------


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``pos``: how many rows of the same tree came before in this partition."""
    last, n = None, 0
    for b in batches:
        i = b.schema.get_field_index("pos")
        out = []
        for t in b.column(b.schema.get_field_index("tree")).to_pylist():
            last, n = t, n + 1 if t == last else 0
            out.append(n)
        yield b.set_column(i, b.schema.field(i), pa.array(out, pa.int64()))


def positions(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, the 0-based position within ``tree`` in the given order; ``nodes`` must be a stored table.

    Range partitions are numbered apart.  A tree can only go on across a border as the last of one
    partition and the first of the next, so one row per partition settles all offsets.
    """
    spark, n = nodes.sparkSession, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["tree", *order]
    rows = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(n, *keys, "tie").sortWithinPartitions(*keys, "tie")
    rows = rows.drop("tie").withColumn("pos", F.lit(0).cast("long")).withColumn("part", F.spark_partition_id())
    rows = staged(rows.mapInArrow(_number, rows.schema), "merkle-order")
    runs = rows.groupBy("part", "tree").agg(F.count("*").alias("n"))
    ends = runs.groupBy("part").agg(F.min(F.struct("tree", "n")).alias("first"), F.max(F.struct("tree", "n")).alias("last")).orderBy("part").collect()
    offsets, tree, held = [], None, 0
    for e in ends:
        before = held if e.first.tree == tree else 0
        offsets.append((e.part, e.first.tree, before))
        tree, held = e.last.tree, e.last.n + (before if e.last.tree == e.first.tree else 0)
    # One row per range partition, so the broadcast is bounded by their number.
    table = spark.createDataFrame(offsets, "part int, tree string, before long")
    joined = rows.join(F.broadcast(table), ["part", "tree"], "left")
    return joined.withColumn("pos", F.col("pos") + F.coalesce("before", F.lit(0))).drop("part", "before")


# --- the sweeps -------------------------------------------------------------------


def _queue(nodes: DataFrame) -> DataFrame:
    """Messages in label order, all of a block in one partition."""
    return nodes.withColumn("block", F.floor(F.col("pos") / WIDTH**HEIGHT)).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Batches cut at block borders, with the row range of each block; a block over a border is held back and joined."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        tree, block = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("tree", "block"))
        cuts = [0] + [i for i in range(1, len(tree)) if block[i] != block[i - 1] or tree[i] != tree[i - 1]]
        if len(cuts) > 1:
            yield b.slice(0, cuts[-1]), list(zip(cuts, cuts[1:]))
        held = [b.slice(cuts[-1])]
    if held:
        yield held[0], [(0, held[0].num_rows)]


def _levels(digests: list[str], block: int) -> list[list[str]]:
    """A block's levels from its nodes up.  Only a tree's only block may have its root before ``HEIGHT`` levels."""
    only = block == 0 and len(digests) < WIDTH**HEIGHT
    out = [digests]
    while len(out[-1]) > 1 if only else len(out) <= HEIGHT:
        low = out[-1]
        out.append([_hash("".join(low[i:i + WIDTH])) for i in range(0, len(low), WIDTH)])
    return out


def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One message per block: its top digest, to the node of the next epoch."""
    for b, spans in _whole_blocks(batches):
        tree, block, digest = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("tree", "block", "digest"))
        tops = [(tree[i], block[i], _levels(digest[i:j], block[i])[-1][0]) for i, j in spans]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tops), (pa.string(), pa.int64(), pa.string()))], names=["tree", "pos", "digest"])


def _paths(levels: list[list[str]], rest: str) -> list[str]:
    """From the top down: each node's siblings on the way up, then ``rest``."""
    above = [rest]
    for low in reversed(levels[:-1]):
        here = []
        for i in range(len(low)):
            first, up = i - i % WIDTH, above[i // WIDTH]
            step = "".join(low[first:i]) + ":" + "".join(low[i + 1:first + WIDTH])
            here.append(f"{step}/{up}" if up else step)
        above = here
    return above


def _sink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Gives each node of a block its proof and its tree's top, from the message at the head of the block."""
    for b, spans in _whole_blocks(batches):
        at = {c: b.schema.get_field_index(c) for c in ("block", "pos", "digest", "proof", "top")}
        block, digest = b.column(at["block"]).to_pylist(), b.column(at["digest"]).to_pylist()
        proof: list[str | None] = []
        top: list[str | None] = []
        for i, j in spans:
            proof += [None, *_paths(_levels(digest[i + 1:j], block[i]), b.column(at["proof"])[i].as_py())]
            top += [b.column(at["top"])[i].as_py()] * (j - i)
        out = b.set_column(at["proof"], b.schema.field(at["proof"]), pa.array(proof, pa.string()))
        out = out.set_column(at["top"], b.schema.field(at["top"]), pa.array(top, pa.string()))
        yield out.filter(pc.greater_equal(out.column(at["pos"]), 0))


def rise(nodes: DataFrame) -> list[DataFrame]:
    """Epochs of ``(tree, pos, digest, ...)`` from the given nodes to one node per tree."""
    epochs = [nodes]
    while True:
        tops = _queue(epochs[-1].select("tree", "pos", "digest")).mapInArrow(_rise, "tree string, pos long, digest string")
        epochs.append(staged(tops, "merkle-epoch"))
        if not epochs[-1].agg(F.max("pos")).first()[0]:  # one number
            return epochs


def sink(epochs: list[DataFrame], tops: DataFrame) -> DataFrame:
    """``proof`` and ``top`` for every node of the first epoch; ``tops`` has ``(tree, proof, top)`` for each tree."""
    above = tops.select("tree", F.lit(0).cast("long").alias("pos"), "proof", "top")
    for nodes in reversed(epochs[:-1]):
        none = F.lit(None).cast("string")
        heads = above.select("tree", (F.col("pos") * WIDTH**HEIGHT).alias("pos"), "proof", "top")
        rows = nodes.withColumn("proof", none).withColumn("top", none)
        # The head carries its block's first position until the block is known, then sorts before it.
        both = rows.withColumn("head", F.lit(False)).unionByName(heads.withColumn("head", F.lit(True)), allowMissingColumns=True)
        both = both.withColumn("block", F.floor(F.col("pos") / WIDTH**HEIGHT)).withColumn("pos", F.expr("IF(head, -1L, pos)")).drop("head")
        both = both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        above = both.mapInArrow(_sink, both.schema).drop("block", "digest") if nodes is not epochs[0] else both.mapInArrow(_sink, both.schema).drop("block")
    return above


def manifest(rows: DataFrame) -> DataFrame:
    """Of a table ``(tree, doc_id, digest, ...)``: ``digest, subroot, root, proof`` for every leaf, other columns kept.

    The names ``pos, part, tie, top, head, block, before`` are the operator's own.
    """
    spark = rows.sparkSession
    leaves = positions(staged(rows, "merkle-leaves"), ["doc_id", "digest"])
    epochs = rise(leaves)
    forest = epochs[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "digest")
    upper = rise(positions(staged(forest, "merkle-subroots"), ["source"]))
    root = upper[-1].select("digest").collect()  # one row, none for an empty table
    root = root[0][0] if root else None
    above = sink(upper, spark.createDataFrame([("", "", root)], "tree string, proof string, top string").where("top IS NOT NULL"))
    subroots = above.select(F.col("source").alias("tree"), "proof", F.col("digest").alias("top"))
    return sink(epochs, staged(subroots, "merkle-proofs")).withColumnRenamed("top", "subroot").withColumn("root", F.lit(root))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for h, proof in zip(b.column(b.schema.get_field_index("start")).to_pylist(), b.column(b.schema.get_field_index("proof")).to_pylist()):
            for step in proof.split("/") if proof else ():
                left, _, right = step.partition(":")
                h = _hash(left + h + right)
            out.append(h)
        i = b.schema.get_field_index("folded_root")
        yield b.set_column(i, b.schema.field(i), pa.array(out, pa.string()))


def fold(rows: DataFrame, start: str = "digest") -> DataFrame:
    """Adds ``folded_root``: what the proof makes of the leaf digest in column ``start``."""
    rows = rows.withColumn("start", F.col(start)).withColumn("folded_root", F.lit(None).cast("string"))
    return rows.mapInArrow(_fold, rows.schema).drop("start")


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf to the root."""
    return F.sha2(F.translate(proof, "/:", ""), 256)


def leaves(docs: DataFrame) -> DataFrame:
    return docs.select(tree_key(F.col("source")).alias("tree"), "doc_id", leaf_digest([F.col(c) for c in FIELDS]).alias("digest"))


def audit(docs: DataFrame) -> DataFrame:
    """Manifest of the documents, checked against a copy whose line breaks are gone where 2 divides the id's crc32.

    A row without an id is not tampered with.
    """
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = leaf_digest([F.translate(F.col(c).cast("string"), "\n", "") if c == "text" else F.col(c) for c in FIELDS])
    plain = leaf_digest([F.col(c) for c in FIELDS])
    rows = docs.select(tree_key(F.col("source")).alias("tree"), "doc_id", plain.alias("digest"),
                       F.when(tampered & F.contains(F.col("text").cast("string"), F.lit("\n")), changed).alias("changed"))
    done = manifest(rows)
    done = fold(done.withColumn("given", F.coalesce("changed", "digest")), "given")
    return done.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                       "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    """The leaf digest in SQL, with ``text`` as the expression of the text field."""
    fields = [f"{text if c == 'text' else c}::VARCHAR" for c in FIELDS]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({f}))::VARCHAR || ':' || {f}, '-')" for f in fields) + ")"


#: All levels of the trees, the siblings of each node, and each leaf's way up.
_TREES_SQL = """
{t} AS (SELECT tree, 0 AS level, pos, n, digest FROM {leaves}
  UNION ALL SELECT tree, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY tree, level, pos // 3, n),
{t}_sibs AS (SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
  coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM {t} a JOIN {t} b ON a.tree = b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.pos),
{t}_path AS (SELECT tree, level, pos, pos AS leaf_pos, []::VARCHAR[] AS steps FROM {t} WHERE level = 0
  UNION ALL SELECT p.tree, p.level + 1, p.pos // 3, p.leaf_pos, list_append(p.steps, s.l || '/' || s.r)
  FROM {t}_path p JOIN {t}_sibs s USING (tree, level, pos)),
{t}_proof AS (SELECT tree, leaf_pos, steps FROM {t}_path JOIN {t} USING (tree, level, pos) WHERE n = 1)"""

ORACLE_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {_leaf_sql("text")} AS digest,
  CASE WHEN coalesce({CRC32_SQL.format("doc_id::VARCHAR")} % 2 = 0, false) THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS given FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM docs),
{_TREES_SQL.format(t="low", leaves="leaves").strip()},
subroots AS (SELECT '' AS tree, tree AS source, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM low WHERE n = 1),
{_TREES_SQL.format(t="high", leaves="subroots").strip()},
whole AS (SELECT l.doc_id, l.digest, l.given, s.digest AS subroot, list_concat(p.steps, q.steps) AS steps
  FROM leaves l JOIN subroots s ON s.source = l.tree JOIN low_proof p ON p.tree = l.tree AND p.leaf_pos = l.pos JOIN high_proof q ON q.leaf_pos = s.pos),
folded AS (SELECT *, list_reduce(list_prepend(given, steps), lambda h, z: sha256(string_split(z, '/')[1] || h || string_split(z, '/')[2])) AS folded_root FROM whole)
SELECT doc_id, digest AS leaf, subroot, root, sha256(replace(array_to_string(steps, ''), '/', '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded CROSS JOIN (SELECT digest AS root FROM high WHERE n = 1)"""

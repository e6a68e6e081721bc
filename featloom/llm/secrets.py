"""Secret scans with an incremental blob ledger (built-in functions only).

Every version of a text is addressed by its content (SHA-256).  The ledger holds
the (blob, rule, rule version) triples that have been scanned and their
findings; an increment scans only the blobs and rule versions it has not seen,
appends to the ledger, and joins the findings back to every path that carries
the blob.  Copies of a text are therefore scanned once.

Spans come from the pieces between matches: ``split`` and ``regexp_extract_all``
walk the same leftmost, non-overlapping matches, so running sums of piece and
match lengths are the match offsets (code points).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from featloom.llm.common import staged, staging_path, text_or_empty


@dataclass(frozen=True)
class Rule:
    """A kind of secret.  ``hints``: lower-case strings of which a matching text has one (cheap pre-check)."""

    kind: str
    pattern: str
    group: int
    min_chars: int
    hints: tuple[str, ...]
    version: int = 1


#: Fixed patterns, in the order in which spans with the same start are listed.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         ("passw", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, ("akia",)),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, ()),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ("eyj",)),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key",)),
)
BASE = ("assign", "access", "hex")
FINDING = "blob string, kind string, version int, start long, end long"


def may_match(rule: Rule, text: str, lowered: str) -> Column:
    """False only for texts without a match: hint strings, or for patterns without one the pattern itself."""
    if not rule.hints:
        return F.col(text).rlike(rule.pattern)
    return reduce(Column.__or__, [F.col(lowered).contains(h) for h in rule.hints])


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings (blob, kind, version, start, end) of distinct ``blobs`` (blob, text)."""
    lowered = blobs.select("blob", "text", F.lower("text").alias("low"))
    flagged = lowered.select("blob", "text", *[may_match(r, "text", "low").alias(f"may_{r.kind}") for r in rules])
    parts = F.array(*[
        F.when(F.col(f"may_{r.kind}"), F.struct(
            F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.min_chars).alias("least"),
            F.arrays_zip(F.split("text", r.pattern, -1).alias("piece"), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0)).alias("hit"),
                         F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)).alias("value")).alias("m")))
        for r in rules])
    rows = (flagged.select("blob", F.explode(parts).alias("p")).where("p IS NOT NULL")
            .select("blob", "p.kind", "p.version", "p.least", F.posexplode("p.m").alias("k", "m"))
            .select("blob", "kind", "version", "least", "k", F.length("m.piece").alias("gap"),
                    F.length("m.hit").alias("n"), F.length("m.value").alias("nv")))
    w = Window.partitionBy("blob", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.col("gap") + F.coalesce("n", F.lit(0))).over(w)
    return (rows.withColumn("end", ends.cast("long")).where(F.col("n").isNotNull() & (F.col("nv") >= F.col("least")))
            .select("blob", "kind", "version", (F.col("end") - F.col("n")).alias("start"), "end"))


class Ledger:
    """Scanned (blob, kind, version) triples and findings, as two growing Parquet tables under ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = path or staging_path(spark, "blob-ledger")

    def _table(self, name: str, schema: str) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self._table("scanned", "blob string, kind string, version int")

    def findings(self) -> DataFrame:
        return self._table("findings", FINDING)

    def increment(self, versions: DataFrame, rules=RULES) -> None:
        """Scan what is new in ``versions`` (blob, text).

        Findings are written before the triples that vouch for them, so a job
        that dies in between scans again and never skips a blob; readers take
        distinct findings.
        """
        blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
        known = self.scanned()
        # On an empty ledger all rules share one pass; later each rule has its own unseen blobs.
        for group in [list(rules)] if known.isEmpty() else [[r] for r in rules]:
            todo = blobs
            if len(group) == 1:
                done = known.where((F.col("kind") == group[0].kind) & (F.col("version") == group[0].version))
                todo = blobs.join(done.select("blob"), "blob", "left_anti")
            hit = reduce(Column.__or__, [may_match(r, "text", "low") for r in group])
            todo = staged(todo.withColumn("low", F.lower("text")).select("blob", F.when(hit, F.col("text")).alias("text")), "blobs-to-scan")
            scan(todo.where("text IS NOT NULL"), group).write.mode("append").parquet(f"{self.path}/findings")
            triples = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in group])
            (todo.select("blob", F.explode(triples).alias("r")).select("blob", "r.kind", "r.version")
             .write.mode("append").parquet(f"{self.path}/scanned"))


def report(paths: DataFrame, ledger: Ledger, rules=RULES) -> DataFrame:
    """``paths`` (with a blob column) plus ``spans``: findings of the current rule versions, by start, then kind as listed."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    spans = (ledger.findings().distinct().where(F.col("version") == current[F.col("kind")])
             .groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", order[F.col("kind")].alias("o"), "end", "kind"))).alias("spans")))
    return paths.join(spans, "blob", "left")


def scan_documents(docs: DataFrame, rules=RULES, ledger: Ledger | None = None) -> DataFrame:
    """One increment over ``docs``: its rows with ``blob`` and ``spans`` (null where none).

    A null text is scanned as an empty one.  Every row is a version; copies
    share a blob, so repeated rows get equal spans.
    """
    ledger = ledger or Ledger(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("blob", "spans", "text")]
    addressed = docs.select(*keep, text_or_empty().alias("text")).withColumn("blob", F.sha2("text", 256))
    ledger.increment(addressed.select("blob", "text"), rules)
    return report(addressed.drop("text"), ledger, rules)


def digest(found: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans and all spans as text."""
    def text(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    spans = F.coalesce("spans", F.expr("CAST(array() AS array<struct<start:bigint,o:int,end:bigint,kind:string>>)"))
    f = found.withColumn("spans", spans)
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return f.select("doc_id", *[count(k) for k in BASE],
                    F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))

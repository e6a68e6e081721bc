"""A training corpus from raw documents: five operators in a row, each over all that its predecessor kept."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import decontam, line_dedup, near_dup, packing, quality
from featloom.llm.catalog import RANKS
from featloom.llm.common import discard, discard_folders, staged, staging_scope, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Folders of working tables that the last stage's result may still read.
_left: list[str] = []


def stage(function):
    """A stage's result is written before the next stage begins, so its working tables go then."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_folders(spark, _left)
        _left.clear()
        with staging_scope(_left):
            return function(spark, docs, sf_dir)

    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the log-likelihood threshold go.

    A null or empty text has no words and goes.  Each row is judged by its own text: repeated rows
    and rows without a doc_id stay or go alike.  Every stage leaves out columns other than COLUMNS,
    whatever their names, and gives no rows for an empty table.
    """
    return quality.run(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select(*COLUMNS)


@stage
def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows the text.

    Every row stays, if need be with an empty text; a null text becomes an empty one.  Rows of one
    doc_id are one document, and so are all rows without a doc_id: they keep each other's lines.
    """
    return line_dedup.dedup(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@stage
def jaccard_regions(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id.

    Rows are linked by their texts whatever their doc_id: of repeated rows one stays, and a row
    without a doc_id only if its group has no other.  Texts that are null or without words stay.
    """
    return near_dup.keep_one(docs).select(*COLUMNS)


@stage
def benchmark_index(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, each row by its own verdict: a doc_id may be null or repeated.

    A null or empty text stays; null items of the benchmark match nothing.
    """
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "decontamination-rows")
    # The operator carries its doc_id through, here the row's own id.
    with staging_scope() as folders:
        verdict = decontam.decontaminate(rows.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
        lost = staged(verdict.where("contaminated").select(F.col("doc_id").alias("_row")), "decontamination-lost")
    discard_folders(spark, folders, lost)
    return without(rows, lost, "_row").select(*COLUMNS)


@stage
def bm25_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 tokens.

    A null or empty text is its end id alone; repeated rows, and rows without a doc_id, are packed
    as often as they occur.
    """
    return packing.pack(docs, RANKS, public_tokenizers.PATTERN).drop("ids")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_runs), ("near_duplicates", jaccard_regions),
          ("decontamination", benchmark_index), ("packing", bm25_packing)]

#: Hashing, prefix joins and tokenisation have no SQL form; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces; nothing else is left in the shared folder."""
    docs, was = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        docs = staged(function(spark, docs, sf_dir), f"stage-{name.replace('_', '-')}")
        discard_folders(spark, _left)
        _left.clear()
        if was is not None:
            discard(was)
        was = docs
    return docs

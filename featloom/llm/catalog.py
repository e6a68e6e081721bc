"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from featloom.llm import (chat, decontam, lang_id, line_dedup, merkle, near_dup, packing, quality, secrets, suffix_dedup, url_filter,
                          warc, whitening)
from featloom.llm.common import staging_path


#: The vocabulary of ``byte_bpe_50k.json`` as ranks: the same ids, encoded several times as fast.
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"))


def op2_prefix_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_t(spark, sf_dir, "documents")).drop("kept")


def op3_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_t(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN).drop("ids")


def op4_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_t(spark, sf_dir, "documents"))


def op5_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.run(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(_t(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _t(spark, sf_dir, "pages")
    return url_filter.verdicts(pages, url_filter.mine(pages, _t(spark, sf_dir, "labels")))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_documents(_t(spark, sf_dir, "documents")))


def op9_chat_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.union(extra)))


def op10_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "warc")
    warc.write_archives(_t(spark, sf_dir, "pages"), path)
    read = warc.read_archives(spark, path)
    full = F.col("payload").isNotNull()
    return read.select(
        "page_id", F.when(full, F.octet_length("payload")).otherwise(F.col("payload_length")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")


def op11_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(_t(spark, sf_dir, "documents"))


def op12_time_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(_t(spark, sf_dir, "documents"))


def op13_feast_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(_t(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {f.__name__: f for f in (op1_positional_index, op2_prefix_doubling, op3_bm25_packing, op4_jaccard_regions, op5_quality_llr, op6_line_runs, op7_url_rules, op8_secret_ledger, op9_chat_columns, op10_warc_source, op11_rank_profiles, op12_time_forward, op13_feast_whitening)}
ORACLES = {"op6_line_runs": line_dedup.ORACLE_SQL, "op10_warc_source": warc.ORACLE_SQL, "op11_rank_profiles": lang_id.ORACLE_SQL, "op12_time_forward": merkle.ORACLE_SQL}

"""Quality rules: hashed n-gram log-likelihood ratio against the raw corpus (built-in functions only).

Two multinomials over hashed word 1- and 2-grams are counted: one over every
document (raw corpus), one over a bounded set of trusted documents.  A
document's score is the mean over its n-grams of ``ln(p_trusted / p_raw)``, and
each document is kept when that mean reaches a fixed threshold.  Bucket weights
are integers (micro-nats), so sums do not depend on the order of addition.

Plan: one narrow pass explodes bucket ids into a map-side aggregate of at most
``buckets`` rows; the second pass reads the weights as one scalar (8 bytes a
bucket) and scores inside each row.  No text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import ASCII_SPACE, staged, text_or_empty

#: Buckets of the hashed n-grams; the model is 8 bytes a bucket.
BUCKETS = 1 << 15
#: Most trusted documents that the target model is fitted on, chosen by id hash.
TRUSTED_MAX = 20_000
#: Lowest mean log ratio (micro-nats an n-gram) that is kept.
THRESHOLD = -100_000
SYMBOLS = "#*$%&|<>"
def _replaced(c: Column, chars: str, by: str) -> Column:
    for ch in chars:
        c = F.replace(c, F.lit(ch), F.lit(by))
    return c


def word_hashes(text: Column) -> Column:
    """Hash of every word; one-character split after plain replaces, which is several times a regex split."""
    words = F.array_remove(F.split(_replaced(text, ASCII_SPACE[1:], " "), " ", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shifted_pairs(a: str, b: str, shift: int) -> str:
    """SQL: hash of a[i] with b[i + shift] for every i that has both."""
    n = f"greatest(size({b}) - {shift}, 0)"
    return f"zip_with(slice({a}, 1, {n}), slice({b}, {shift + 1}, {n}), (x, y) -> xxhash64(x, y))"


#: SQL over ``wh`` and ``g4`` (hashes of words and of 4-word windows): words in
#: 5-word windows found twice or more.  A repeated 5-word window holds two
#: repeated 4-word windows, so only such rows build and sort the 5-word hashes;
#: a comparison of neighbours marks the repeated windows, and the covered words
#: are the gaps between their starts, at most 5 each.  ``transform(array(x), v ->
#: ...)[0]`` binds x once, so no array is rebuilt for every element.
_ORDERED = "sort_array(transform(g, (h, i) -> named_struct('h', h, 'i', i)))"
_REPEATED = ("filter(s, (x, k) -> (k > 0 AND s[greatest(k - 1, 0)].h = x.h) "
             "OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h))")
_STARTS = f"sort_array(transform(transform(array({_ORDERED}), s -> {_REPEATED})[0], x -> x.i))"
_COVERED = (f"aggregate({_STARTS}, named_struct('prev', -5, 'n', 0), "
            "(a, i) -> named_struct('prev', i, 'n', a.n + least(5, i - a.prev)), a -> a.n)")
REPEATED_WORDS = ("CASE WHEN size(g4) - size(array_distinct(g4)) < 2 THEN 0 ELSE "
                  f"transform(array({shifted_pairs('g4', 'wh', 4)}), g -> {_COVERED})[0] END")


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, trusted_max: int = TRUSTED_MAX) -> DataFrame:
    """One row: ``weights`` (array of ``buckets`` longs).  Raw counts cover all documents.

    ``labels`` (doc_id, quality): rows with quality 1 are trusted; of those, the
    ``trusted_max`` with the smallest id hash are used (bounded, so broadcast).
    No labels or no documents give zero-information weights (all equal).
    """
    spark = docs.sparkSession
    trusted = (labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_max).withColumn("t", F.lit(1)))
    words = (docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(trusted), "doc_id", "left")
             .select("t", word_hashes(F.col("text")).alias("wh")).where(F.size("wh") > 0))
    both = f"array(pmod(wh[i], {buckets}), CASE WHEN i + 1 < size(wh) THEN pmod(xxhash64(wh[i], wh[i + 1]), {buckets}) END)"
    counts = (words.select("t", "wh", F.explode(F.expr("sequence(0, size(wh) - 1)")).alias("i"))
              .select("t", F.explode(F.expr(both)).alias("b")).where("b IS NOT NULL")
              .groupBy("b").agg(F.count("*").alias("r"), F.count("t").alias("t")))
    full = spark.range(buckets).withColumnRenamed("id", "b").join(counts, "b", "left").fillna(0)
    rows = staged(full.select("b", "r", "t"), "ngram-counts")
    total = rows.agg(F.sum("r").alias("rs"), F.sum("t").alias("ts"))
    weighed = rows.join(F.broadcast(total)).select("b", F.expr(
        f"CAST(round(1e6 * (ln((t + 1) / (ts + {buckets})) - ln((r + 1) / (rs + {buckets})))) AS BIGINT)").alias("w"))
    return weighed.agg(F.expr("transform(array_sort(collect_list(struct(b, w))), x -> x.w)").alias("weights"))


def score(docs: DataFrame, model: DataFrame, threshold: int = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """``docs`` with the base counts, ``llr`` (micro-nats an n-gram), ``base_failed`` and ``kept``.

    One output row per input row, so repeated rows each get the same verdict.
    A null or empty text has no words: all counts 0, ``llr`` null, base failed.
    Input columns with the names of computed ones are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr", "base_failed", "kept"]
    keep = [c for c in docs.columns if c not in made]
    text = F.col("_t")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(ASCII_SPACE))) > 0)
    symbols = F.length(text) - F.length(_replaced(text, SYMBOLS, ""))
    summed = lambda c, v: F.aggregate(c, F.lit(0).cast("long"), lambda a, h: a + v[F.pmod(h, F.lit(buckets)).cast("int")])
    total = F.transform(F.array("_w"), lambda v: summed("wh", v) + summed("g2", v))[0]
    # The input's columns travel in one struct, so that none of them meets a helper column.
    return (docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_in"), text_or_empty().alias("_t"))
            .select("*", word_hashes(text).alias("wh"))
            .select("*", F.expr(shifted_pairs("wh", "wh", 1)).alias("g2"))
            .select("*", F.expr(shifted_pairs("g2", "g2", 2)).alias("g4"), lines.alias("_lines"))
            # Used once and alone in its projection, the weights are inlined rather than copied into every row.
            .select("*", model.scalar().alias("_w"))
            .select("_in", F.size("wh").cast("long").alias("n_words"),
                    F.length(_replaced(text, ASCII_SPACE, "")).cast("long").alias("word_chars"),
                    F.when(text.rlike(f"[{SYMBOLS}]"), symbols).otherwise(0).cast("long").alias("n_symbols"),
                    (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
                    F.expr(f"CAST({REPEATED_WORDS} AS BIGINT)").alias("n_repeat_words"),
                    F.when(F.size("wh") > 0, F.expr("2 * size(wh) - 1")).alias("_n"), total.alias("_s"))
            .withColumn("llr", F.expr("_s DIV _n"))
            .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
            .withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold))
            # A filter on ``kept`` must not move below: Catalyst would copy all hashing into it, once per use.
            .withColumn("kept", F.when(F.monotonically_increasing_id() >= 0, F.col("kept")))
            .select("_in.*", *made))


def run(docs: DataFrame, labels: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    return score(docs, train(docs, labels), threshold)

"""Language identification by rank-order profiles of character n-grams (out-of-place distance).

Words are maximal runs of letters and marks (Unicode L and M), each code point
lower-cased where its lower case is one code point.  A word with a space on
either side gives its 1-, 2- and 3-grams: of ``_ab_`` these are ``a b``,
``_a ab b_`` and ``_ab ab_``.  A profile lists the ``PROFILE`` most frequent
n-grams, ties in code point order.

* Learning: n-grams are counted per language over all given rows (combined per
  batch, then summed by Spark) and the most frequent of each language are
  ranked.  The result is a table ``(lang, gram, rank, n)``.
* Prediction: a document's own profile is compared with each language's.  An
  n-gram at rank i in the one and j in the other is ``|i - j|`` out of place, one
  that the language's profile lacks is ``PROFILE``.  The language with the least
  sum wins; ties go to the smallest name.  ``score`` is one minus that sum over
  its largest possible value.

The profiles of ``LANG_BLOCK`` languages at a time travel to the tasks (at most
``LANG_BLOCK * PROFILE`` rows); more languages are taken in further blocks of the
same pass over the texts, so that any number gives the same result.

Rows: a null text, or one without a letter, is ``und`` with score 0, and so is
every row when nothing was learned.  A row with a null language or text teaches
nothing.  Repeated rows count as often as they occur.  Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featloom.llm.common import chunks, mix

PROFILE = 400
LANG_BLOCK = 256
#: No code point from here on is a letter.
LIMIT = 0x40000
_BITS = 21
_SPACE = 0x20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is a letter, is a letter or mark, its lower case."""
    chars = [chr(c) for c in range(LIMIT)]
    kind = np.array([unicodedata.category(c)[0] for c in chars])
    lower = np.array([ord(x) if len(x := c.lower()) == 1 else ord(c) for c in chars], np.int64)
    return kind == "L", (kind == "L") | (kind == "M"), lower


def pack(gram: str) -> int:
    """Up to three code points as one number; numbers compare as the texts do."""
    a, b, c = ([ord(x) for x in gram] + [0, 0])[:3]
    return a << 2 * _BITS | b << _BITS | c


def unpack(code: int) -> str:
    return "".join(chr(c) for s in (2, 1, 0) if (c := code >> s * _BITS & (1 << _BITS) - 1))


def _words(texts: list[str]) -> tuple[np.ndarray, ...]:
    """All texts as one padded row of lower-cased code points, the span and text of each word, and which texts have a letter."""
    letter, inside, lower = _tables()
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[codes >= LIMIT] = _SPACE
    word = inside[codes]
    edge = np.diff(word.astype(np.int8))
    start, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    first = np.cumsum([1, *(len(t) + 1 for t in texts)])
    has_letter = np.zeros(len(texts), bool)
    if len(start):
        has_letter = np.add.reduceat(np.append(letter[codes], False).astype(np.int64), first[:-1]) > 0
        has_letter &= np.diff(first) > 1
    doc = np.searchsorted(first, start, side="right") - 1
    return np.where(word, lower[codes], _SPACE), start, end, doc, has_letter


def _word_keys(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's code points (8 code points a step; longer words loop on)."""
    h = (end - start).astype(np.uint64)
    at = start.copy()
    alive = np.arange(len(start))
    while len(alive):
        h[alive] = mix(h[alive] * np.uint64(0x9E3779B97F4A7C15) + codes[at[alive]].astype(np.uint64))
        at[alive] += 1
        alive = alive[at[alive] < end[alive]]
    return h


def _ranges(lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and offset of every element of consecutive runs of the given lengths."""
    owner = np.repeat(np.arange(len(lens)), lens)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(lens) - lens, lens)


def _sums(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sum of ``n`` for each."""
    if not len(key):
        return key, n
    bits = int(n.max()).bit_length()
    if int(key.max()).bit_length() + bits < 63:
        both = np.sort(key << bits | n)
        key, n = both >> bits, both & (1 << bits) - 1
    else:
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[at], np.add.reduceat(n, at)


def count_grams(texts: list[str], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of the texts, and for each (group, n-gram) its count; a text is its own group if none is given.

    Returns the n-grams in ascending order, then group, index of the n-gram and count in ascending
    order of the first two, and which texts have a letter.
    """
    codes, start, end, doc, has_letter = _words(texts)
    none = np.empty(0, np.int64)
    if not len(start):
        return none, none, none, none, has_letter
    _, first, word = np.unique(_word_keys(codes, start, end), return_index=True, return_inverse=True)
    n_words = len(first)
    pair, times = _sums((doc if group is None else group[doc]) * n_words + word, np.ones(len(word), np.int64))
    # The n-grams of each distinct word, word after word.
    s, lens = start[first], (end - start)[first]
    owner, off = _ranges(lens)
    at = s[owner] + off
    one, before, after = codes[at], codes[at - 1], codes[at + 1]
    # Beside a word there is always a character that is none, so each neighbour is of the word or a space.
    last = codes[s + lens - 1]
    grams = np.concatenate([one << 2 * _BITS, before << 2 * _BITS | one << _BITS, last << 2 * _BITS | _SPACE << _BITS,
                            before << 2 * _BITS | one << _BITS | after])
    of = np.concatenate([owner, owner, np.arange(n_words), owner])
    known, gid = np.unique(grams, return_inverse=True)
    gid = gid[np.argsort(of, kind="stable")]
    per = 3 * lens + 1
    begin = np.cumsum(per) - per
    wid = pair % n_words
    row, off = _ranges(per[wid])
    key, n = _sums((pair // n_words)[row] * len(known) + gid[begin[wid][row] + off], times[row])
    return known, key // len(known), key % len(known), n, has_letter


def _texts(col: pa.Array) -> list[str]:
    return [b.decode("utf-8", "replace") if b else "" for b in col.cast(pa.binary()).to_pylist()]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        langs = b.column(1).dictionary_encode()
        known, lang, gid, n, _ = count_grams(_texts(b.column(0)), langs.indices.to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), pa.array(known[gid]), pa.array(n)], names=["lang", "gram", "n"])


def learn(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """Profiles ``(lang, gram, rank, n)`` of all rows with a text and a language; ``unpack`` gives an n-gram's text."""
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(_learn, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranks = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # The rank filter becomes a limit per language in every task before the shuffle (WindowGroupLimit).
    return counts.withColumn("rank", F.row_number().over(ranks) - 1).where(F.col("rank") < profile).select("lang", "gram", "rank", "n")


def _judge(block: list[tuple[str, np.ndarray, np.ndarray]], profile: int):
    """Best language so far of each row, against one block of profiles (n-grams ascending, with their ranks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            best = b.column(b.schema.get_field_index("distance")).to_pylist()
            name = b.column(b.schema.get_field_index("lang_pred")).to_pylist()
            known, doc, gid, n, has_letter = count_grams(_texts(b.column(b.schema.get_field_index("text"))))
            size = np.zeros(b.num_rows, np.int64)
            if len(doc):
                most, g = int(n.max()), len(known)
                key = (doc * (most + 1) + most - n) * g + gid
                if (b.num_rows * (most + 1) * g).bit_length() > 62:
                    order = np.lexsort((gid, -n, doc))
                    doc, gid = doc[order], gid[order]
                else:
                    key.sort()
                    doc, gid = key // g // (most + 1), key % g
                rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
                doc, gid, rank = doc[rank < profile], gid[rank < profile], rank[rank < profile]
                size = np.bincount(doc, minlength=b.num_rows)
                for lang, grams, ranks in block:
                    at = np.minimum(np.searchsorted(grams, known), len(grams) - 1)
                    place = np.where(grams[at] == known, ranks[at], -1)[gid]
                    off = np.where(place < 0, profile, np.abs(place - rank))
                    total = np.bincount(doc, off, b.num_rows).astype(np.int64)  # sums below 2**53 are exact
                    for i in np.flatnonzero(has_letter):
                        if best[i] is None or (total[i], lang.encode()) < (best[i], name[i].encode()):
                            best[i], name[i] = int(total[i]), lang
            cols = {"distance": pa.array(best, pa.int64()), "lang_pred": pa.array(name, pa.string()), "grams": pa.array(size)}
            yield pa.RecordBatch.from_arrays([cols.get(f.name, b.column(i)) for i, f in enumerate(b.schema)], schema=b.schema)

    return run


def _blocks(profiles: DataFrame, size: int) -> Iterator[list[tuple[str, np.ndarray, np.ndarray]]]:
    """Blocks of at most ``size`` languages, each with its n-grams in ascending order and their ranks."""
    per = profiles.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("gram", "rank"))).alias("p")).orderBy("lang")
    block = []
    for r in per.toLocalIterator():
        block.append((r.lang, np.array([x.gram for x in r.p], np.int64), np.array([x["rank"] for x in r.p], np.int64)))
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def predict(docs: DataFrame, profiles: DataFrame, profile: int = PROFILE, lang_block: int = LANG_BLOCK) -> DataFrame:
    """``doc_id, lang_pred, score, distance, grams`` of every row; ``grams`` is the size of its own profile."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.lit(None).cast("long").alias("distance"),
                       F.lit(None).cast("string").alias("lang_pred"), F.lit(0).cast("long").alias("grams"))
    for block in _blocks(profiles, lang_block):
        rows = rows.mapInArrow(_judge(block, profile), rows.schema)
    score = F.coalesce(1 - F.col("distance") / F.nullif(F.col("grams") * profile, F.lit(0)), F.lit(0.0))
    return rows.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), score.alias("score"), "distance", "grams")


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    """Whether the crc32 of the id as text leaves the remainder ``fold``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def identify(docs: DataFrame, profile: int = PROFILE) -> DataFrame:
    """Learn from the rows that are not held out, then predict all; a row without an id is neither held out nor learned from."""
    out = held_out(F.col("doc_id"))
    found = predict(docs, learn(docs.where(~out), profile), profile)
    return found.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "lang_pred", "score", "distance")


#: crc32 of a text of ASCII characters, bit by bit.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))))"""

ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text, lang, {CRC32_SQL.format("doc_id::VARCHAR")} % 4 = 2 AS held FROM documents),
words AS (SELECT r, ' ' || word || ' ' AS w, count(*) AS n FROM (SELECT r, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}]+')) AS word FROM docs) GROUP BY r, word),
grams AS (SELECT r, g, sum(n)::BIGINT AS n FROM (
  SELECT r, n, unnest(list_concat(list_transform(range(2, length(w)), lambda i: w[i]),
    list_transform(range(1, length(w)), lambda i: w[i:i + 1]), list_transform(range(1, length(w) - 1), lambda i: w[i:i + 2]))) AS g FROM words) GROUP BY r, g),
learned AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, g) - 1 AS rank FROM (
  SELECT lang, g, sum(n) AS n FROM grams JOIN docs USING (r) WHERE lang IS NOT NULL AND NOT held GROUP BY lang, g) QUALIFY rank < {PROFILE}),
own AS (SELECT r, g, row_number() OVER (PARTITION BY r ORDER BY n DESC, g) - 1 AS rank FROM grams QUALIFY rank < {PROFILE}),
total AS (SELECT r, count(*) AS m FROM own GROUP BY r),
met AS (SELECT r, learned.lang, sum(abs(own.rank - learned.rank) - {PROFILE}) AS less FROM own JOIN learned USING (g) GROUP BY r, learned.lang),
best AS (SELECT r, lang, (m * {PROFILE} + coalesce(less, 0))::BIGINT AS distance, m FROM total CROSS JOIN (SELECT DISTINCT lang FROM learned) LEFT JOIN met USING (r, lang)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, lang) = 1)
SELECT doc_id, coalesce(held, false) AS held_out, coalesce(best.lang, 'und') AS lang_pred,
  CASE WHEN best.lang IS NULL THEN 0.0::DOUBLE ELSE 1 - distance::DOUBLE / (m * {PROFILE}) END AS score, distance
FROM docs LEFT JOIN best USING (r)"""

"""Rank-order profiles against plain counting."""

import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest

from featloom.llm import lang_id as li

SCHEMA = "doc_id long, text string, lang string, rank string, gram string, distance string, grams string, lang_pred string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x", "x", "x") for r in rows], SCHEMA)


def grams(text):
    out, word = Counter(), ""
    low = "".join(x if len(x := c.lower()) == 1 else c for c in text or "")
    for c in low + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            p = f" {word} "
            out.update(word)
            out.update(p[i:i + 2] for i in range(len(p) - 1))
            out.update(p[i:i + 3] for i in range(len(p) - 2))
            word = ""
    return out


def ranked(counts):
    return {g: i for i, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:li.PROFILE])}


def brute(rows):
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _, _ in rows if i is not None}
    langs = {}
    for i, t, lang in rows:
        if i is not None and not held[i] and t is not None and lang is not None:
            langs.setdefault(lang, Counter()).update(grams(t))
    langs = {k: ranked(c) for k, c in langs.items() if c}
    out = []
    for i, t, _ in rows:
        own = ranked(grams(t))
        found = min(((sum(abs(r - p[g]) if g in p else li.PROFILE for g, r in own.items()), k) for k, p in langs.items()), default=None)
        if found is None or not any(unicodedata.category(c)[0] == "L" for c in t or ""):
            out.append((i, held.get(i, False), "und", 0.0))
        else:
            out.append((i, held.get(i, False), found[1], 1 - found[0] / (len(own) * li.PROFILE)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rnd = np.random.default_rng(5)
    words = {"en": "the of and to in that is was for it with as his on be at by", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht",
             "fr": "de la le et les des en un du une que est pour qui dans à l'été"}
    out = [(i, " ".join(rnd.choice(words[lang].split(), rnd.integers(1, 60))) + ".\n", lang) for i, lang in enumerate(rnd.choice(list(words), 120).tolist())]
    # The first row recalls the casing of "İ", whose lower case is two code points, and characters beyond 16 bits.
    odd = ["İSTANBUL Straße ΣΑΣ", "𝐀𝐁 𠀀𠀁 ab", "", None, "12 345 !?", "a", "\n\n", "́", "été ", "x" * 3000, "the " * 5000, "的一是不了", "\U000e0100 \U0010ffff"]
    out += [(500 + i, t, [None, "en", "de"][i % 3]) for i, t in enumerate(odd)]
    return out + out[:3] + [(None, "the of and to", "en"), (None, "der die und", None), (3, None, "xx")]


def got(df):
    return sorted([(r.doc_id, r.held_out, r.lang_pred, r.score) for r in df.collect()], key=repr)


def test_equals_plain_counting(spark, rows):
    df = frame(spark, rows).repartition(5)
    assert got(li.identify(df)) == brute(rows)


def test_profiles_and_blocks_of_languages(spark, rows):
    df = frame(spark, rows)
    fit = df.where("lang = 'de'")
    want = Counter()
    for _, t, lang in rows:
        if lang == "de":
            want.update(grams(t))
    assert {li.unpack(r.gram): (r["rank"], r.n) for r in li.learn(fit).collect()} == {g: (k, want[g]) for g, k in ranked(want).items()}
    profiles = li.learn(df)
    whole = li.predict(df, profiles).collect()
    assert sorted(map(tuple, li.predict(df, profiles, lang_block=1).collect()), key=repr) == sorted(map(tuple, whole), key=repr)


@pytest.mark.parametrize("some", [[], [(1, None, "en")], [(1, "", "en"), (2, "12", None)], [(1, "words only", None)]])
def test_nothing_learned(spark, some):
    assert got(li.identify(frame(spark, some))) == brute(some)


def test_long_words_and_fallback_keys():
    a, b = np.array([3, 1, 3]), np.array([2**62, 1, 5])
    assert [list(x) for x in li._sums(a, b)] == [[1, 3], [1, 2**62 + 5]]
    assert li.pack("ab") < li.pack("aba") < li.pack("b") and li.unpack(li.pack("\U0010ffffé")) == "\U0010ffffé"
    assert re.fullmatch("[01]+", "".join(str(int(x)) for x in li.count_grams(["a", "", "1", "𝐀"])[4]))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    judged = li.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL AND lang_pred <> 'und'")
    right, n = judged.selectExpr("sum(int(lang = lang_pred))", "count(*)").first()
    print(f"held-out accuracy {right}/{n}")
    assert right >= 0.95 * n

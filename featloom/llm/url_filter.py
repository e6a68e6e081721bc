"""URL filters: site rules, and association rules mined from labelled URLs (built-in functions only).

Spark's FP-growth mines frequent combinations of URL tokens and the label.  Rules
``tokens -> bad`` (block) and ``tokens -> good`` (allow) are kept when they reach
the support and confidence bounds, when their confidence is above the label's
overall share beyond chance, and when no shorter rule of the same verdict implies
them.  Each rule is indexed under its rarest token; a URL is checked only against
the rules that its own tokens lead to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from featloom.llm.common import lower_ascii, staged

#: (host and path prefix, verdict); a rule fits its host and all subdomains.
SITE_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Share of the labelled URLs that a rule must cover, and the share of those that must have its label.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: A rule's confidence, lowered by this many standard errors (Wilson's bound), must exceed its label's share of all URLs.
#: Five, as thousands of combinations are tried.
Z = 5.0
BAD, GOOD = "label=bad", "label=good"
#: Rules are broadcast up to this many; beyond it the index is joined by shuffle.
BROADCAST_RULES = 50_000
RULE = "tokens array<string>, verdict string, confidence double, lift double, support double"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substr(url, F.instr(url, "://") + 3), "#", 1)).otherwise("")
    rest = F.coalesce(F.substring_index(rest, "?", 1), F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return lower_ascii(host), F.substr(rest, F.length(host) + 1)


def site_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = SITE_RULES) -> Column:
    """The longest rule that fits (its text), else null.  ``rules`` is a short fixed list."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        site, _, tail = rule.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + tail)
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return out if out is not None else F.lit(None).cast("string")


def tokens(host: str, path: str, url: str) -> Column:
    """Distinct URL tokens: host labels, path segments (numbers as ``#``), query keys, scheme."""
    return F.expr(f"""array_distinct(concat(
      transform(array_remove(split({host}, '[.]'), ''), x -> concat('host:', x)),
      transform(array_remove(split({path}, '/'), ''), x -> concat('path:', regexp_replace(x, '[0-9]+', '#'))),
      transform(regexp_extract_all(coalesce({url}, ''), '[?&]([^=&#]+)=', 1), x -> concat('query:', x)),
      filter(array(concat('scheme:', substring_index(coalesce({url}, ''), '://', 1))), x -> {host} <> '')))""")


def mine(pages: DataFrame, labels: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, z: float = Z) -> DataFrame:
    """Rules (tokens, verdict, confidence, lift, support): URL token combinations whose labelled pages are mostly bad, or good.

    A page is labelled by the row of ``labels`` (doc_id, quality, toxic) with its
    id; bad means quality 0 or toxic 1 in any such row.  ``lift`` is the
    confidence over the label's share of all labelled URLs.  A rule that contains
    a shorter rule of its verdict is dropped (the shorter one decides).  Without
    URLs of both labels there is no rule.
    """
    host, path = split_url(F.col("url"))
    bad = (labels.groupBy(F.col("doc_id").alias("page_id"))
           .agg(F.coalesce(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)), F.lit(False)).alias("bad")))
    baskets = (pages.select("page_id", "url", host.alias("host"), path.alias("path")).where(F.col("host") != "")
               .join(bad, "page_id")
               .select(F.concat(tokens("host", "path", "url"), F.expr(f"array(IF(bad, '{BAD}', '{GOOD}'))")).alias("items")))
    baskets = staged(baskets, "url-baskets")
    n, share = baskets.agg(F.count("*"), F.avg(F.array_contains("items", BAD).cast("int"))).first()
    if not n or share in (0.0, 1.0):
        return pages.sparkSession.createDataFrame([], RULE)
    # Even a rule without exception is within chance on fewer URLs than this, so none of them is grown.
    rarer = min(share, 1 - share)
    beyond_chance = z * z * rarer / (1 - rarer) / n
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, beyond_chance)), minConfidence=min_confidence).fit(baskets)
    covers, p = F.round(F.col("support") * n / F.col("confidence")), F.col("confidence")
    lowest = (p + z * z / 2 / covers - z * F.sqrt(p * (1 - p) / covers + z * z / 4 / covers / covers)) / (1 + z * z / covers)
    label = F.col("consequent")[0]
    found = (model.associationRules.where(label.isin(BAD, GOOD) & (lowest > p / F.col("lift")))
             .select(F.array_sort("antecedent").alias("tokens"), F.when(label == BAD, "block").otherwise("allow").alias("verdict"),
                     "confidence", "lift", "support"))
    found = staged(found, "url-rules")
    # A rule is compared with the rules whose rarest token it holds.
    counts = found.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    short = index(found.select("tokens", "verdict"), counts).select(F.col("tokens").alias("s"), F.col("verdict").alias("v"), "token")
    implied = (found.select("tokens", "verdict", F.explode("tokens").alias("token")).join(short, "token")
               .where((F.col("verdict") == F.col("v")) & (F.size("s") < F.size("tokens")) & (F.size(F.array_except("s", "tokens")) == 0))
               .select("tokens", "verdict").distinct())
    return found.join(implied, ["tokens", "verdict"], "left_anti")


def index(rules: DataFrame, token_counts: DataFrame) -> DataFrame:
    """``rules`` and ``token``: every rule under its rarest token (fewest URLs, ties by text)."""
    return (rules.select(F.struct("*").alias("rule"), F.explode("tokens").alias("token")).join(token_counts, "token", "left")
            .groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
            .select("rule.*", "token"))


def verdicts(pages: DataFrame, rules: DataFrame, site_rules: Sequence[tuple[str, str]] = SITE_RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, mined`` per row of ``pages``.

    The site rule decides.  Without one, the mined rule of most confidence that
    the URL fits decides (block, when both verdicts have it); a URL that fits
    none is allowed.  A null url or one without ``://`` has an empty host
    and path and is allowed.  Repeated rows are judged alike.
    """
    host, path = split_url(F.col("url"))
    rows = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = staged(rows.where(F.col("host") != "").select("url", "host", "path").distinct()
                  .select("url", tokens("host", "path", "url").alias("have")), "url-tokens")
    counts = urls.select(F.explode("have").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    by_token = staged(index(rules.select("tokens", "verdict", "confidence"), counts), "url-rule-index")
    if by_token.count() <= BROADCAST_RULES:
        by_token = F.broadcast(by_token)
    mined = (urls.select("url", "have", F.explode("have").alias("token")).join(by_token, "token")
               .where(F.size(F.array_except("tokens", "have")) == 0)
               .groupBy("url").agg(F.count("*").alias("mined"), F.max(F.struct("confidence", "verdict"))["verdict"].alias("said")))
    rule = site_rule(F.col("host"), F.col("path"), site_rules)
    said = F.create_map(*[F.lit(x) for r in site_rules for x in r]).cast("map<string,string>")
    return (rows.join(mined, "url", "left").withColumn("rule", rule)
            .select("page_id", "host", "path", "rule",
                    F.when(F.col("rule").isNotNull(), said[F.col("rule")]).otherwise(F.coalesce("said", F.lit("allow"))).alias("verdict"),
                    F.coalesce("mined", F.lit(0)).cast("long").alias("n_mined_rules")))

"""URL filters: fixed host/path rules, then association rules mined from labels.

Every url becomes a set of tokens: host labels (``h:``), path parts (``p:``)
and query parts (``q:``), lower case, runs of digits as ``#``.  Spark's
FP-growth mines the token sets of the labelled *bad* pages (quality 0 or toxic
1) for combinations that at least ``min_support`` of the bad pages and at least
``min_count`` hold.  Their confidence is the share of bad pages among all
labelled pages that hold the combination.  Pruned are combinations below
``min_confidence``, longer than ``max_tokens``, no more often bad than chance
allows (``sigmas`` standard deviations above the share of bad pages among all
labelled ones), and those implied by a shorter kept rule.

Tokens that the same labelled pages hold are one item, so the many parts of
one long url do not make a power set; a rule on items stands for a rule on
each choice of one token an item (those on several tokens of an item are
implied by it) and is never written out to apply it.  Single items are settled
before FP-growth runs: a kept one implies every longer combination with it and
leaves the baskets.  FP-growth itself has no bound on length, so many items
that often come together, none of which is a rule alone, are still costly.

Rules meet pages through an inverted index: each rule is filed under the
tokens of its rarest item, a page looks up its own tokens only, and the other
items of a found rule are verified inside the page's token array.  Matches
come back by the number of the page's row, never by url.

Native: DataFrame expressions and the JVM implementation of FP-growth.  Only
urls, never page bodies, are shuffled.  The rule table is counted before it
may be broadcast; otherwise it joins by shuffle.

Defined results
---------------
* null url, or none with ``://``: host and path empty, no tokens, verdict
  ``allow`` with a null rule.
* repeated pages: one output row for each input row.
* null ``page_id``: kept; such a page is never a labelled one.
* no labels, no bad page or no other one: no mined rules.
* several label rows for a page: bad if one of them says so.
* very long urls: all their tokens take part.
* extra columns in either table are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.tables import discard, materialize, maybe_broadcast

#: (verdict, host, path) of the fixed rules.
HOST_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.5
MAX_TOKENS = 3
MIN_COUNT = 10
SIGMAS = 3.0


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, query of every page row."""
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(
        "page_id",
        "url",
        lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1).alias("path"),
        F.regexp_extract(url, "://[^?#]*\\?([^#]*)", 1).alias("query"),
    )


def url_tokens(host: Column, path: Column, query: Column) -> Column:
    def parts(text: Column, pattern: str, kind: str) -> Column:
        plain = F.regexp_replace(lower_ascii(text), "[0-9]+", "#")
        return F.transform(F.filter(F.split(plain, pattern), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))

    return F.array_sort(F.array_distinct(F.concat(
        parts(host, "[.]", "h:"), parts(path, "[/._-]", "p:"), parts(query, "[&=+]", "q:"),
    )))


def fixed_rule(host: Column, path: Column, rules=HOST_RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fixed rule that fits, null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def labelled_tokens(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(tokens, bad) of every labelled page; labels meet pages by id."""
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    said = (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    )
    parts = url_parts(pages).join(said, "page_id")
    return parts.select(url_tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"), "bad").filter(F.size("tokens") > 0)


def match(baskets: DataFrame, rules: DataFrame, n_rules: int, keys: list[str]) -> DataFrame:
    """(keys..., rule items) of every rule whose items a basket (column ``held``) has all of; a rule is filed under its ``key``."""
    ruled = rules.select(F.col("key").alias("_key"), F.col("items"))
    looked = baskets.select(*keys, "held", F.explode("held").alias("_key"))
    found = looked.join(maybe_broadcast(ruled, n_rules, 200), "_key")
    return found.filter(F.size(F.array_except("items", "held")) == 0).select(*keys, "items")


def merged_items(known: DataFrame, least: int) -> DataFrame:
    """(item, tokens, support, seen): tokens that at least ``least`` bad pages hold, those of the same labelled pages together under the smallest."""
    held = known.select("row", "bad", F.explode("tokens").alias("token"))
    who = held.groupBy("token").agg(
        F.sum(F.col("bad").cast("bigint")).alias("support"), F.count(F.lit(1)).alias("seen"),
        F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("a"), F.sum(F.xxhash64("row", F.lit(1)).cast("decimal(20,0)")).alias("b"),
    )
    grouped = who.filter(F.col("support") >= least).groupBy("support", "seen", "a", "b")
    return grouped.agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens")).select("item", "tokens", "support", "seen")


def mine_items(
    pages: DataFrame, labels: DataFrame, min_support: float, min_confidence: float, max_tokens: int, min_count: int, sigmas: float
) -> tuple[DataFrame, DataFrame]:
    """Stored tables (items, key, support, confidence) of pruned rules, filed under their rarest item, and (item, tokens).

    Single items are rules or not by their counts.  A kept one leaves the
    baskets before FP-growth runs, as every longer combination is implied by
    it; so does one that all labelled pages hold, as it changes no count.
    """
    spark = pages.sparkSession
    known = materialize(labelled_tokens(pages, labels).withColumn("row", F.monotonically_increasing_id()), "url-labelled")
    row = known.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad")).first()
    n, n_bad = row["n"], row["bad"] or 0
    least = max(min_count, math.ceil(min_support * n_bad))
    if n_bad < least or n_bad in (0, n):
        discard(known)
        none = spark.createDataFrame([], "items array<string>, key string, support bigint, confidence double")
        return none, spark.createDataFrame([], "item string, tokens array<string>")
    share = n_bad / n
    sound = (F.col("support") / F.col("seen") >= min_confidence) & (F.col("support") - F.col("seen") * share >= sigmas * F.sqrt(F.col("seen") * (share * (1 - share))))
    merged = materialize(merged_items(known, least).withColumn("sound", sound), "url-items")
    confidence = (F.col("support") / F.col("seen")).alias("confidence")
    single = merged.filter("sound").select(F.array("item").alias("items"), F.col("item").alias("key"), "support", confidence)
    open_ = merged.filter(~F.col("sound") & (F.col("seen") < n))
    of = open_.select("item", "seen", F.explode("tokens").alias("token"))
    baskets = known.select("row", "bad", F.explode("tokens").alias("token")).join(of, "token")
    baskets = materialize(baskets.groupBy("row").agg(F.first("bad").alias("bad"), F.collect_set("item").alias("held")).filter(F.size("held") > 1), "url-baskets")
    bought = baskets.filter("bad").select(F.col("held").alias("items"))
    rules = single
    spent = [known, baskets]
    if max_tokens > 1 and not bought.isEmpty():
        floor = (least - 0.5) / bought.count()
        sets = FPGrowth(itemsCol="items", minSupport=min(floor, 1.0), minConfidence=1.0).fit(bought).freqItemsets
        sets = sets.filter(F.size("items").between(2, max_tokens) & (F.col("freq") >= least)).select(F.array_sort("items").alias("items"))
        usage = open_.select("item", "seen")
        rarest = sets.select("items", F.explode("items").alias("item")).join(usage, "item").groupBy("items").agg(F.min(F.struct("seen", "item"))["item"].alias("key"))
        rarest = materialize(rarest, "url-itemsets")
        held = match(baskets, rarest, rarest.count(), ["bad"]).groupBy("items").agg(F.sum(F.col("bad").cast("long")).alias("support"), F.count(F.lit(1)).alias("seen")).filter(sound)
        several = materialize(held.join(rarest, "items").select("items", "key", "support", confidence), "url-several")
        # a rule is implied by a kept rule that is a proper subset of it
        longer = several.select(F.col("items").alias("held"), F.col("items").alias("longer"))
        implied = match(longer, several, several.count(), ["longer"]).filter(F.size("longer") > F.size("items")).select(F.col("longer").alias("items")).distinct()
        rules = single.unionByName(several.join(implied, "items", "left_anti"))
        spent += [rarest, several]
    rules, items = materialize(rules, "url-rules"), materialize(merged.select("item", "tokens"), "url-tokens")
    discard(merged, *spent)
    return rules, items


def mine_rules(
    pages: DataFrame,
    labels: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS,
    min_count: int = MIN_COUNT,
    sigmas: float = SIGMAS,
) -> DataFrame:
    """(items, support, confidence) of the rules written out: a row for each choice of one token an item.

    For reading; :func:`url_filter` applies the rules without writing them out.
    """
    rules, items = mine_items(pages, labels, min_support, min_confidence, max_tokens, min_count, sigmas)
    out = rules.select(F.monotonically_increasing_id().alias("rule"), F.col("items").alias("parts"), F.array().cast("array<string>").alias("items"), "support", "confidence")
    for i in range(max_tokens):
        step = out.withColumn("item", F.get("parts", F.lit(i))).join(items, "item", "left").withColumn("_t", F.explode_outer("tokens"))
        out = step.select("rule", "parts", F.when(F.col("_t").isNull(), F.col("items")).otherwise(F.concat("items", F.array("_t"))).alias("items"), "support", "confidence")
    return out.select(F.array_sort("items").alias("items"), "support", "confidence")


def applied(pages: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """``row`` of the pages (row, tokens) that hold a token of every item of some rule.

    Rules are filed under every token of their rarest item.  What is looked up
    is one row for each token of such an item, and one for each rule with the
    tokens of its other items.
    """
    ruled = rules.select(F.monotonically_increasing_id().alias("rule"), "items", "key")
    ruled = materialize(ruled, "url-filed")
    keys = materialize(ruled.select("rule", F.col("key").alias("item")).join(items, "item").select("rule", F.explode("tokens").alias("_token")), "url-keys")
    others = ruled.select("rule", F.explode(F.array_except("items", F.array("key"))).alias("item")).join(items, "item")
    others = materialize(others.groupBy("rule").agg(F.collect_list("tokens").alias("others")), "url-others")
    n_tokens = others.agg(F.sum(F.aggregate("others", F.lit(0), lambda n, x: n + F.size(x)))).first()[0] or 0
    looked = pages.select("row", "tokens", F.explode("tokens").alias("_token")).join(maybe_broadcast(keys, keys.count(), 100), "_token")
    found = looked.join(maybe_broadcast(others, n_tokens, 100), "rule", "left")
    fits = F.col("others").isNull() | F.forall("others", lambda x: F.arrays_overlap(x, F.col("tokens")))
    return found.filter(fits).select("row").distinct()


def url_filter(
    pages: DataFrame,
    labels: DataFrame,
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    max_tokens: int = MAX_TOKENS,
    min_count: int = MIN_COUNT,
    sigmas: float = SIGMAS,
    host_rules=HOST_RULES,
) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (a mined rule matched) for every page row."""
    rules, items = mine_items(pages, labels, min_support, min_confidence, max_tokens, min_count, sigmas)
    parts = materialize(url_parts(pages).drop("url").withColumn("row", F.monotonically_increasing_id()), "url-parts")
    tokens = url_tokens(F.col("host"), F.col("path"), F.col("query"))
    hits = applied(parts.select("row", tokens.alias("tokens")), rules, items).withColumn("mined", F.lit(True))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), host_rules)
    return (
        parts.join(hits, "row", "left")
        .withColumn("mined", F.coalesce("mined", F.lit(False)))
        .select(
            "page_id", "host", "path", rule.alias("rule"),
            F.coalesce(verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"),
            "mined",
        )
    )

"""Quality rules by a hashed n-gram log-likelihood ratio.

Words are runs of characters other than ASCII white space.  Unigrams and
bigrams of every document are hashed (xxhash64) into ``n_buckets`` buckets.
Two multinomials over the buckets are estimated with additive smoothing: the
trusted target (documents whose label row says quality 1 and toxic 0) and the
raw corpus (all documents).  A document's score is the sum of
``log(p_target / p_raw)`` over its n-grams divided by their number; a document
is kept when its base rules hold and the score reaches ``threshold``.

Native: only DataFrame expressions.  The bucket table has a fixed number of
rows, so it is folded into the scoring expression as one literal; the scoring
pass is a scan with no shuffle.  The counting pass combines on the map side
and shuffles at most ``n_buckets`` rows a task.

Defined results
---------------
* null text, empty text: no words, all counts 0, ``base_failed`` true.
* repeated rows: one output row for each input row.
* null ``doc_id``: kept as null; such a row is never trusted.
* no label rows, or no trusted ones: the ratio is 0 everywhere, so the
  verdict is that of the base rules.
* several label rows for a document: trusted only if all of them say so.
* extra columns in either table are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.tables import maybe_broadcast, stable_sample

N_BUCKETS = 1 << 14
#: Trusted documents, by a hash of the id, beyond which no more are asked for; the raw corpus is counted whole.
MAX_TRUSTED = 1_000_000
THRESHOLD = -0.05
SMOOTHING = 1.0
#: Java regular expressions: ASCII white space, anything else, counted symbols.
SPACE = "[ \\t-\\r]+"
NOT_SPACE = "[^ \\t-\\r]"
SYMBOLS = "[#*$%&|<>]"


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ngram_buckets(words: Column, n_buckets: int) -> Column:
    """Bucket numbers of all unigrams and bigrams of an array of words."""
    m = F.lit(n_buckets)
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), m).cast("int"))
    heads = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    two = F.transform(heads, lambda w, i: F.pmod(F.xxhash64(w, F.get(words, i + 1)), m).cast("int"))
    return F.concat(one, two)


def bucket_counts(docs: DataFrame, n_buckets: int = N_BUCKETS) -> DataFrame:
    """(bucket, n, n_trusted) over all n-grams of ``docs`` in one pass; ``trusted`` is 1 or null."""
    words = docs.select("trusted", split_words(F.col("text")).alias("words"))
    return (
        words.select("trusted", F.explode(ngram_buckets(F.col("words"), n_buckets)).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.count("trusted").alias("n_trusted"))
    )


def trusted_ids(labels: DataFrame) -> DataFrame:
    ok = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return (
        labels.filter(F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(F.coalesce(ok, F.lit(False))).alias("ok"))
        .filter("ok")
        .select("doc_id")
    )


def log_ratios(docs: DataFrame, labels: DataFrame, n_buckets: int = N_BUCKETS, smoothing: float = SMOOTHING) -> list[float]:
    """log(p_target / p_raw) of every bucket; always ``n_buckets`` numbers."""
    ids = trusted_ids(labels)
    n = ids.count()
    ids = stable_sample(ids, "doc_id", MAX_TRUSTED, n).withColumn("trusted", F.lit(1))
    known = docs.select("doc_id", "text").join(maybe_broadcast(ids, min(n, 2 * MAX_TRUSTED), 12), "doc_id", "left")
    target, raw = [0] * n_buckets, [0] * n_buckets
    for row in bucket_counts(known, n_buckets).collect():  # n_buckets rows at most
        target[row["bucket"]], raw[row["bucket"]] = row["n_trusted"] or 0, row["n"]
    if not sum(target):
        return [0.0] * n_buckets
    nt, nr = sum(target) + smoothing * n_buckets, sum(raw) + smoothing * n_buckets
    return [round(math.log((t + smoothing) / nt) - math.log((r + smoothing) / nr), 5) for t, r in zip(target, raw)]


def base_columns(docs: DataFrame) -> DataFrame:
    """``docs`` with words and the base counts; one row for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", text.alias("text"), split_words(F.col("text")).alias("words"))
    n = F.size("words")
    words = F.col("words")
    heads = F.slice(words, 1, F.greatest(n - 2, F.lit(0)))
    df = df.select(
        "doc_id",
        "words",
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(NOT_SPACE)).alias("lines"),
        F.transform(heads, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))).alias("windows"),
    )
    windows = F.col("windows")
    ordered = F.when(
        F.size(F.array_distinct(windows)) < F.size(windows),
        F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
    )
    df = df.select(
        "doc_id",
        "words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        ordered.alias("ordered"),
    )
    o = F.col("ordered")
    again = F.filter(
        o,
        lambda x, i: F.coalesce(x["h"] == F.get(o, i - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(o, i + 1)["h"], F.lit(False)),
    )
    df = df.withColumn("starts", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("ordered")
    starts = F.col("starts")
    covered = F.aggregate(
        F.transform(starts, lambda v, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - v, F.lit(3)))),
        F.lit(0),
        lambda acc, x: acc + x,
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def score(words: Column, ratios: list[float]) -> Column:
    """Mean log ratio over the n-grams; 0 for a document without words."""
    m = F.lit(len(ratios))
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<double>")  # folded to one literal

    def step(acc: Column, x: Column) -> Column:
        return F.struct(
            (acc["s"] + F.get(table, F.pmod(F.xxhash64(x), m).cast("int"))
             + F.when(acc["p"].isNull(), F.lit(0.0)).otherwise(F.get(table, F.pmod(F.xxhash64(acc["p"], x), m).cast("int")))).alias("s"),
            x.alias("p"),
        )

    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("string").alias("p"))
    total = F.aggregate(words, start, step, lambda acc: acc["s"])
    n = F.size(words)
    return F.when(n == 0, F.lit(0.0)).otherwise(total / (F.greatest(2 * n - 1, F.lit(1))))


def quality_filter(
    docs: DataFrame,
    labels: DataFrame,
    n_buckets: int = N_BUCKETS,
    threshold: float = THRESHOLD,
    smoothing: float = SMOOTHING,
) -> DataFrame:
    """Base counts, log-likelihood score and verdict for every document row."""
    ratios = log_ratios(docs, labels, n_buckets, smoothing)
    df = base_columns(docs)
    n = F.size("words").cast("long")
    df = df.select(
        "doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        score(F.col("words"), ratios).alias("llr"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    return df.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"),
        "llr",
    )

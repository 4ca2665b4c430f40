"""Builds reply trees of conversations and writes them as a checked submission.

    python -m jobs.reply_trees --config jobs/reply_trees.json --conversations IN --out OUT

For users who have a table of records in time and need a lineage forest of it,
valid by the rules of a submission: here the records are turns of a
conversation, and a turn is linked to the one it most likely answers.

1. Turns become nodes: frame = turn, position = (words, distinct words,
   characters).  Rows without conversation or turn, or with a turn outside
   0..TURNS - 1, are set aside; of repeated (conversation, turn) the first by
   role and text stays.
2. Every turn meets the ``window`` turns before it, by an equi-join on
   (conversation, turn); the share of common words of their whole texts is the
   link's probability, the number of turns between its length.
3. Links below ``min_overlap`` go; each turn keeps its best parent, then each
   parent its best ``max_replies`` replies.
4. Trees are the weakly connected components.

Written: ``OUT/threads/dataset=`` (a row a turn: parent, -1 for a root,
probability, tree), ``OUT/submission/dataset=`` (CSV of the usual columns) and
``OUT/set_aside`` (rule and count of what was left out).  A conversation goes
to one of ``parts`` datasets by its id.  The submission is checked before
anything is written.  A rerun replaces all three with the same rows.
"""

from __future__ import annotations

import argparse
import logging
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladeframe.operators import graph as G
from cladeframe.scratch import remove, stored
from cladeframe.sources import adapters
from cladeframe.sources import submission as S

LOG = logging.getLogger("jobs.reply_trees")
TURNS = 1_000_000
THREADS = "dataset string, node_id bigint, conv_id bigint, turn bigint, role string, n_words bigint, parent_id bigint, probability double, tree bigint, tree_size bigint"
DEFAULTS = {"window": 3, "min_overlap": 0.02, "max_replies": 2, "parts": 16}


def settings_of(spark: SparkSession, path: str | None) -> dict:
    """The config file's values over the defaults; unknown names are an error."""
    found = {} if path is None else {k: v for k, v in spark.read.option("multiLine", True).json(path).first().asDict().items() if v is not None}
    unknown = sorted(set(found) - set(DEFAULTS))
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return DEFAULTS | found


def words(text: Column) -> Column:
    """Lower-case words of a whole text."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(low, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def turns(conversations: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(turns, set aside): a row a turn with its distinct words; rule and count of rows left out."""
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    inside = F.col("turn").between(0, TURNS - 1)
    rule = F.when(F.col("conv_id").isNull() | F.col("turn").isNull(), "no_key").when(~inside, "turn_out_of_range")
    order = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = rows.withColumn("rule", rule)
    first = rows.filter("rule IS NULL").withColumn("place", F.row_number().over(order))
    aside = rows.filter("rule IS NOT NULL").select("rule").unionByName(first.filter("place > 1").select(F.lit("repeated_turn").alias("rule")))
    said = first.filter("place = 1").withColumn("w", words(F.col("text")))
    out = said.select(
        F.concat(F.lit("part-"), F.pmod("conv_id", F.lit(parts)).cast("string")).alias("dataset"), (F.col("conv_id") * TURNS + F.col("turn")).alias("node_id"),
        "conv_id", "turn", "role", F.size("w").cast("bigint").alias("n_words"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"), F.array_distinct("w").alias("w"),
    )
    return out, aside.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def candidate_links(said: DataFrame, window: int) -> DataFrame:
    """dataset, source, target, probability, distance of every turn and each of the ``window`` turns before it."""
    b = said.select("dataset", "conv_id", F.col("node_id").alias("target"), F.col("w").alias("wb"), "turn", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("back"))
    b = b.withColumn("turn", F.col("turn") - F.col("back"))
    a = said.select("conv_id", "turn", F.col("node_id").alias("source"), F.col("w").alias("wa"))
    common = F.size(F.array_intersect("wa", "wb"))
    total = F.size("wa") + F.size("wb") - common
    share = F.when(total > 0, common / total).otherwise(F.lit(0.0))
    return b.join(a, ["conv_id", "turn"]).select("dataset", "source", "target", share.alias("probability"), F.col("back").cast("double").alias("distance"))


def reply_links(said: DataFrame, settings: dict) -> DataFrame:
    able = candidate_links(said, int(settings["window"])).filter(F.col("probability") >= settings["min_overlap"])
    return G.best_by(G.best_by(able, "target"), "source", k=int(settings["max_replies"]))


def build(spark: SparkSession, conversations: str, out: str, settings: dict) -> dict:
    """Reads the table at ``conversations`` and writes OUT; returns counts of what was read and written."""
    table = spark.read.parquet(conversations)
    said, aside = turns(table, int(settings["parts"]))
    said = stored(said, "reply-turns")
    links = stored(reply_links(said, settings), "reply-links")
    nodes = said.select(
        "dataset", "node_id", F.col("turn").cast("int").alias("t"), F.col("n_words").cast("double").alias("z"),
        F.size("w").cast("double").alias("y"), F.col("n_chars").cast("double").alias("x"),
    )
    edges = links.select("dataset", "source", "target")
    rows = adapters.submission(nodes, edges)
    broken = S.violations(rows).unionByName(G.violations(nodes, edges).withColumn("id", F.col("id").cast("string"))).first()
    if broken is not None:
        raise ValueError(f"{broken['dataset']}: {broken['rule']} ({broken['id']})")
    labels = G.components(nodes, edges)
    trees = stored(labels, "reply-trees")
    sizes = trees.groupBy("dataset", F.col("component").alias("tree")).agg(F.count(F.lit(1)).alias("tree_size"))
    parents = links.select("dataset", F.col("target").alias("node_id"), F.col("source").alias("parent_id"), "probability")
    key = ["dataset", "node_id"]
    threads = said.join(trees.withColumnRenamed("component", "tree"), key).join(sizes, ["dataset", "tree"]).join(parents, key, "left")
    threads = threads.withColumn("parent_id", F.coalesce("parent_id", F.lit(-1).cast("bigint")))
    threads = threads.select(*(F.col(f.split()[0]) for f in THREADS.split(", ")))
    threads.hint("rebalance", "dataset").write.partitionBy("dataset").mode("overwrite").parquet(f"{out}/threads")
    ordered = rows.repartitionByRange("dataset", "row_type", "t").sortWithinPartitions("dataset", F.col("row_type").desc(), "t", "node_id", "source_id", "target_id")
    ordered.write.partitionBy("dataset").mode("overwrite").option("header", True).csv(f"{out}/submission")
    aside.coalesce(1).write.mode("overwrite").json(f"{out}/set_aside")  # three rows at most
    left = {r["rule"]: r["n"] for r in aside.collect()}
    counts = {"turns": said.count(), "links": links.count(), "trees": sizes.count(), **left}
    remove(said, links, trees, labels)
    LOG.info("read %s, wrote %s: %s", conversations, out, counts)
    return counts


def result(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(THREADS).parquet(f"{out}/threads")


def main() -> None:
    parser = argparse.ArgumentParser(description="Reply trees of conversations as a checked submission.")
    for name in ("conversations", "out"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("reply_trees").getOrCreate()
    try:
        build(spark, args.conversations, args.out, settings_of(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

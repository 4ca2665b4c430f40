"""Keeps frames of detections and the links between them up to date as event files arrive.

    python -m jobs.track_ledger --config jobs/track_ledger.json --events IN --out OUT --checkpoint CHECKPOINT

For users who track objects while recordings still come in: linking all frames
again for every new file would grow with the whole history.  A file stream
takes the files that it has not seen (its checkpoint knows them) and ends when
there are none.  Each micro-batch

1. folds its events to partial sums by frame (day) and object (user) and writes
   them to ``OUT/partials/t=/batch=``;
2. merges all partial sums of the frames that it touched to detections;
3. links each touched frame, and the one before it, to the next frame: pairs
   within ``gate`` where each end is the other's nearest (ties: smaller ids);
4. replaces these frames' partitions of ``OUT/graph/t=``, each with the frame's
   ``node`` rows, its ``edge`` rows to the next frame and one ``frame`` row of
   counts.

A batch that is run again after a failure has the same number and files, so it
replaces its own partial sums and the same frames: the result is that of one
run.  Sums are whole micro-units, so they do not depend on the order of files.

Events without time or user belong to no frame and are left out; null values
count as events but not in the mean.  Frames that no batch touched are neither
read nor written.
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.operators.spatial import mutual_nearest
from cladeframe.scratch import remove, stored

LOG = logging.getLogger("jobs.track_ledger")
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
PARTIALS = "user_id bigint, n bigint, k bigint, total bigint, most bigint, t int, batch bigint"
GRAPH = (
    "dataset string, row_type string, node_id bigint, z double, y double, x double, source_id bigint, target_id bigint, distance double, "
    "n_nodes bigint, n_links bigint, t int"
)
DEFAULTS = {"origin": "2024-01-01", "gate": 2.0, "files_per_batch": 1000}
#: A detection's id is user * FRAMES + frame.
FRAMES = 100_000


def settings_of(spark: SparkSession, path: str | None) -> dict:
    """The config file's values over the defaults; unknown names are an error."""
    found = {} if path is None else {k: v for k, v in spark.read.option("multiLine", True).json(path).first().asDict().items() if v is not None}
    unknown = sorted(set(found) - set(DEFAULTS))
    if unknown:
        raise ValueError(f"unknown settings: {unknown}")
    return DEFAULTS | found


def partial_sums(events: DataFrame, batch: int, origin: str) -> DataFrame:
    micro = F.round(F.col("value") * 1e6).cast("bigint")
    known = events.filter("ts IS NOT NULL AND user_id IS NOT NULL")
    return known.groupBy("user_id", F.datediff("ts", F.lit(origin)).cast("int").alias("t")).agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("k"), F.sum(micro).alias("total"), F.max(micro).alias("most")
    ).select("user_id", "n", "k", "total", "most", "t", F.lit(batch).cast("bigint").alias("batch"))


def detections(partials: DataFrame) -> DataFrame:
    """dataset, node_id, t, z (mean value / 10), y (events), x (largest value / 10)."""
    whole = partials.groupBy("user_id", "t").agg(*(F.sum(c).alias(c) for c in ("n", "k", "total")), F.max("most").alias("most"))
    return whole.select(
        F.lit("U").alias("dataset"), (F.col("user_id") * FRAMES + F.col("t")).alias("node_id"), "t",
        (F.col("total") / F.col("k") / 1e7).alias("z"), F.col("n").cast("double").alias("y"), (F.col("most") / 1e7).alias("x"),
    )


def mutual_links(here: DataFrame, there: DataFrame, gate: float) -> DataFrame:
    """dataset, t, source, target, distance of pairs within the gate in which each is the other's nearest."""
    near = mutual_nearest(here, there, gate, shift=1)
    return near.select("dataset", "t", F.col("left_id").alias("source"), F.col("right_id").alias("target"), "distance")


def frames(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of the graph table: nodes, edges to the next frame, and a row of counts a frame; what a row does not use is -1, or null if it is no whole number."""
    fields = [f.split() for f in GRAPH.split(", ")]

    def rows(df: DataFrame, kind: str) -> DataFrame:
        df = df.withColumn("row_type", F.lit(kind))
        unused = lambda k: F.lit(-1 if k == "bigint" else None)
        return df.select(*((F.col(c) if c in df.columns else unused(k)).cast(k).alias(c) for c, k in fields))

    edges = links.select("dataset", "t", F.col("source").alias("source_id"), F.col("target").alias("target_id"), "distance")
    n = nodes.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.groupBy("dataset", "t").agg(F.count(F.lit(1)).alias("n_links"))
    counts = n.join(m, ["dataset", "t"], "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return rows(nodes, "node").unionByName(rows(edges, "edge")).unionByName(rows(counts, "frame"))


def replace_partitions(df: DataFrame, path: str, *by: str) -> None:
    """Write ``df`` over the partitions that it has rows for; the others stay."""
    df.hint("rebalance", by[0]).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def fold_batch(events: DataFrame, batch: int, out: str, settings: dict) -> tuple[int, int]:
    """Brings OUT up to date with one batch; returns (events folded, frames replaced)."""
    spark = events.sparkSession
    replace_partitions(partial_sums(events, batch, settings["origin"]), f"{out}/partials", "t", "batch")
    partials = spark.read.schema(PARTIALS).parquet(f"{out}/partials")
    touched = partials.filter(F.col("batch") == batch).groupBy("t").agg(F.sum("n").alias("n")).collect()  # a row a frame
    if not touched:
        return 0, 0
    days = {r["t"] for r in touched}
    redone = sorted(days | {d - 1 for d in days})
    nodes = stored(detections(partials.filter(F.col("t").isin(sorted({d + k for d in redone for k in (0, 1)})))), "ledger-nodes")
    here = nodes.filter(F.col("t").isin(redone))
    links = stored(mutual_links(here, nodes, settings["gate"]), "ledger-links")
    replace_partitions(frames(here, links), f"{out}/graph", "t")
    n_frames = here.select("t").distinct().count()
    remove(nodes, links)
    return sum(r["n"] for r in touched), n_frames


def update(spark: SparkSession, events: str, out: str, checkpoint: str, settings: dict) -> dict:
    """Takes the event files that are new since the last run; returns counts of what was read and written."""
    counts = {"batches": 0, "events": 0, "frames": 0}

    def one(df: DataFrame, batch: int) -> None:
        n, m = fold_batch(df, batch, out, settings)
        LOG.info("batch %d: %d events read from %s, %d frames written to %s/graph", batch, n, events, m, out)
        counts.update(batches=counts["batches"] + 1, events=counts["events"] + n, frames=counts["frames"] + m)

    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", int(settings["files_per_batch"])).parquet(events)
    stream = source.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    LOG.info("done: %s", counts)
    return counts


def result(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(GRAPH).parquet(f"{out}/graph")


def main() -> None:
    parser = argparse.ArgumentParser(description="Link new detections to the frames around them.")
    for name in ("events", "out", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config")
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("track_ledger").getOrCreate()
    try:
        update(spark, args.events, args.out, args.checkpoint, settings_of(spark, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()

"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "cladeframe.scratch.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; without that setting a temporary one, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_KEY, None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cladeframe-")
        spark.conf.set(_KEY, found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: a lost executor costs a re-read, not a recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def by_task(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that every task hashes its part of: Spark takes a packed table for small and would send it whole through the driver."""
    return df.hint("shuffle_hash")


def remove(*frames: DataFrame) -> None:
    """Delete tables written by :func:`stored`; their readers must be done."""
    for df in frames:
        path = getattr(df, "_stored_path", None)
        if path:
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def placed(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` stored with its place (``_at``, from 0) in a total order of all rows.

    Rows are dealt by ranges of the order; a place is the partition's offset,
    from one count a partition, and the row's number within it.  No task sees
    more than its own range.
    """
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    ahead, offsets = 0, []
    for r in rows.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("low")).orderBy("_part").collect():  # a row a partition
        offsets.append((r["_part"], ahead - r["low"]))
        ahead += r["n"]
    shift = df.sparkSession.createDataFrame(offsets, "_part int, _shift bigint")
    out = rows.join(F.broadcast(shift), "_part").withColumn("_at", F.col("_row") + F.col("_shift")).drop("_part", "_row", "_shift")
    out._stored_path = rows._stored_path
    return out


def fresh_ids(df: DataFrame, nodes: DataFrame, order: list[str], column: str = "node_id") -> DataFrame:
    """``df`` with ids that follow the largest id of each row's dataset in ``nodes``, dense in the given order."""
    rows = placed(df, ["dataset", *order], "fresh-ids")
    first = rows.groupBy("dataset").agg(F.min("_at").alias("_first"))
    last = nodes.groupBy("dataset").agg(F.max("node_id").alias("_last"))
    known = rows.join(first, "dataset").join(last, "dataset", "left")
    return known.withColumn(column, F.coalesce("_last", F.lit(-1).cast("bigint")) + 1 + F.col("_at") - F.col("_first")).drop("_at", "_first", "_last")

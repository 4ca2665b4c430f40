"""Shared table helpers: materialised intermediates, checked broadcasts, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.scratch import remove, stored

#: Bytes up to which a table may be broadcast: its counted rows times the width of a row.
BROADCAST_BYTES = 16 << 20

materialize, discard = stored, remove


def tidy(spark: SparkSession) -> None:
    """Between the rounds of a long job: a collection in the JVMs of driver and executors.

    In the driver it lets Spark delete the files and broadcasts of finished
    shuffles; in the executors, called from as many rows as there are cores, it
    returns heap that earlier rounds grew to the Python workers beside them.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).selectExpr("reflect('java.lang.System', 'gc') AS gc").collect()  # nulls, a row a core
    spark.sparkContext._jvm.System.gc()


def fits_broadcast(rows: int, row_bytes: int = 16) -> bool:
    return rows * row_bytes <= BROADCAST_BYTES


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int = 16) -> DataFrame:
    """Mark ``df`` for broadcast only if its counted ``rows`` of ``row_bytes`` are within BROADCAST_BYTES."""
    return F.broadcast(df) if fits_broadcast(rows, row_bytes) else df


#: Rows of one Arrow batch of texts; Spark's default of 10,000 holds both ends of the pipe to gigabytes for long texts.
TEXT_ROWS = 1000


def map_text(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` in batches small enough for long texts; the setting stays with the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key, "10000")) <= TEXT_ROWS:
        df.sparkSession.conf.set(key, str(TEXT_ROWS))
    return df.mapInArrow(function, schema)


#: Rows of a partition, and so of a file, of a small intermediate table.
PART_ROWS = 1 << 15


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """``df``, known to have at most ``rows`` rows, in no more partitions than PART_ROWS asks for: a small table becomes few files."""
    return df.coalesce(max(1, -(-rows // PART_ROWS)))


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stable_sample(df: DataFrame, key: str, bound: int, rows: int) -> DataFrame:
    """About ``bound`` of ``rows`` rows, chosen by a hash of ``key`` alone; never more than twice as many, however often a key repeats."""
    if rows <= bound:
        return df
    share = int(bound / rows * (1 << 30))
    return df.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < share).limit(2 * bound)

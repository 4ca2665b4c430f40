"""Node, edge and evaluation tables built from the relational test tables.

``E``: points in ten frames from ``embeddings``; ``U``: tracks of users by day
from ``events``; ``L``: forks of orders into their lines.  The strings in
``SQL`` build the same tables in DuckDB as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.operators.pairs import Pairs

SHIFT = 1_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: dataset, node_id, t, z, y, x, label."""
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select(
        F.lit("E").alias("dataset"), F.col("vec_id").alias("node_id"), (F.col("vec_id") % 10).cast("int").alias("t"),
        *((e[i].cast("double") * 100).alias(axis) for i, axis in enumerate("zyx")), "label",
    )


def chain_edges(n: DataFrame) -> DataFrame:
    """node -> node + 1 within ten frames."""
    a, b = n.select("dataset", "node_id", "t"), n.select("dataset", F.col("node_id").alias("target"))
    return a.filter("t < 9").withColumn("target", F.col("node_id") + 1).join(b, ["dataset", "target"], "left_semi").select(
        "dataset", F.col("node_id").alias("source"), "target"
    )


def forest_edges(n: DataFrame) -> DataFrame:
    """Chains with divisions: every seventh node also leads to node + 11, which then loses its own chain edge."""
    known = n.select("dataset", F.col("node_id").alias("target"))
    split = n.filter("t < 9 AND node_id % 7 = 0").select("dataset", F.col("node_id").alias("source"), (F.col("node_id") + 11).alias("target"))
    split = split.join(known, ["dataset", "target"], "left_semi").select("dataset", "source", "target")
    kept = chain_edges(n).join(split.select("dataset", "target"), ["dataset", "target"], "left_anti").select("dataset", "source", "target")
    return kept.unionByName(split)


def predicted_nodes(n: DataFrame) -> DataFrame:
    """A shifted copy with small fixed jitter and every eleventh node missing."""
    def moved(axis: str, k: int):
        return (F.col(axis) + ((F.col("node_id") * k) % 11 - 5) / 100.0).alias(axis)

    return n.filter("node_id % 11 <> 0").select(
        "dataset", (F.col("node_id") + SHIFT).alias("node_id"), "t", moved("z", 3), moved("y", 5), moved("x", 7)
    )


def predicted_edges(n: DataFrame) -> DataFrame:
    """Forest edges between predicted nodes, less some, plus wrong ones."""
    known = n.filter("node_id % 11 <> 0").select("dataset", F.col("node_id").alias("id"))
    right = forest_edges(n).filter("source % 13 <> 0")
    wrong = n.filter("t < 9 AND node_id % 17 = 0").select("dataset", F.col("node_id").alias("source"), (F.col("node_id") + 21).alias("target"))
    both = right.unionByName(wrong).distinct()
    both = both.join(known.withColumnRenamed("id", "source"), ["dataset", "source"], "left_semi")
    both = both.join(known.withColumnRenamed("id", "target"), ["dataset", "target"], "left_semi")
    return both.select("dataset", (F.col("source") + SHIFT).alias("source"), (F.col("target") + SHIFT).alias("target"))


def scored_edges(n: DataFrame, source: DataFrame | None = None, target: DataFrame | None = None) -> DataFrame:
    """Candidate edges t -> t + 1 within 30 with a fixed pseudo-probability: dataset, source, target, t, probability, distance; then the figures of their ends."""
    from cladeframe.operators.spatial import radius_join

    a = b = n.drop("label")
    kept = {end: [c for c in df.columns if c not in ("dataset", end)] for end, df in (("source", source), ("target", target)) if df is not None}
    if source is not None:
        a = a.join(source.withColumnRenamed("source", "node_id"), ["dataset", "node_id"], "left")
    if target is not None:
        b = b.join(target.withColumnRenamed("target", "node_id"), ["dataset", "node_id"], "left")
    if source is not None and target is None:  # targets go to the neighbour cells: a source meets them all in one task, its figures are not copied
        near = radius_join(b, a, 30.0, shift=-1, right_keep=kept["source"])
        t, s, g = F.col("t") - 1, F.col("right_id"), F.col("left_id")
    else:
        near = radius_join(a, b, 30.0, shift=1, left_keep=kept.get("source", ()), right_keep=kept.get("target", ()))
        t, s, g = F.col("t"), F.col("left_id"), F.col("right_id")
    return near.select(
        "dataset", s.alias("source"), g.alias("target"), t.alias("t"), (((s * 31 + g * 17) % 97) / 97.0).alias("probability"), "distance",
        *kept.get("source", ()), *kept.get("target", ()),
    )


def scored_pairs(n: DataFrame) -> Pairs:
    """:func:`scored_edges` for figures by end without a shuffle of the edges."""
    return Pairs(lambda source, target: scored_edges(n, source, target))


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U: dataset, node_id, t, z, y, x, user_id."""
    ev = read(spark, sf_dir, "events")
    day = F.datediff("ts", F.lit("2024-01-01"))
    return ev.groupBy("user_id", day.alias("t")).agg(
        (F.avg("value") / 10).alias("z"), F.count(F.lit(1)).cast("double").alias("y"), (F.max("value") / 10).alias("x")
    ).select(F.lit("U").alias("dataset"), (F.col("user_id") * 100 + F.col("t")).alias("node_id"), F.col("t").cast("int").alias("t"), "z", "y", "x", "user_id")


def order_forks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L: edges from an order to each of its distinct lines."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return lines.select(
        F.lit("L").alias("dataset"), F.col("l_orderkey").cast("bigint").alias("source"),
        (-(F.col("l_orderkey") * 10 + F.col("l_linenumber"))).cast("bigint").alias("target"),
    )


def submission(n: DataFrame, e: DataFrame) -> DataFrame:
    """Node and edge rows of a graph as one table with -1 for what is not used."""
    minus, minus_d = F.lit(-1).cast("bigint"), F.lit(-1.0)
    top = n.select("dataset", F.lit("node").alias("row_type"), "node_id", F.col("t").cast("bigint").alias("t"), "z", "y", "x", minus.alias("source_id"), minus.alias("target_id"))
    low = e.select("dataset", F.lit("edge").alias("row_type"), minus.alias("node_id"), minus.alias("t"), minus_d.alias("z"), minus_d.alias("y"), minus_d.alias("x"), F.col("source").alias("source_id"), F.col("target").alias("target_id"))
    return top.unionByName(low)


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V: dataset, c, t, z, y, x, value: every vector is a plane of 8 by 8 voxels, six planes a frame, three frames a channel, two channels a dataset."""
    v, i = F.col("vec_id"), F.col("i")
    each = read(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e"))
    return each.select(
        F.concat(F.lit("V"), F.floor(v / 36).cast("string")).alias("dataset"), (F.floor(v / 18) % 2).cast("int").alias("c"), (F.floor(v / 6) % 3).cast("int").alias("t"),
        (v % 6).cast("int").alias("z"), F.floor(i / 8).cast("int").alias("y"), (i % 8).cast("int").alias("x"), (F.bround(F.col("e").cast("double") * 200, 0) + 50).alias("value"),
    )


def checkpoint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """epoch, checkpoint, fold, score from the events: day, type, parity of the user, mean value."""
    ev = read(spark, sf_dir, "events")
    return ev.groupBy(
        F.datediff("ts", F.lit("2024-01-01")).cast("int").alias("epoch"), F.col("event_type").alias("checkpoint"),
        F.concat(F.lit("fold_"), (F.col("user_id") % 2).cast("string")).alias("fold"),
    ).agg(F.round(F.avg("value") / 500, 9).alias("score"))


#: Common table expressions of DuckDB; ``with_tables`` joins those that a query names.
SQL = {
    "e": """SELECT 'E' AS dataset, vec_id AS node_id, CAST(vec_id % 10 AS INTEGER) AS t, CAST(embedding[1] AS DOUBLE) * 100 AS z,
      CAST(embedding[2] AS DOUBLE) * 100 AS y, CAST(embedding[3] AS DOUBLE) * 100 AS x, label FROM embeddings""",
    "g": "SELECT a.dataset, a.node_id AS source, b.node_id AS target FROM e a JOIN e b ON b.node_id = a.node_id + 1 WHERE a.t < 9",
    "d": "SELECT a.dataset, a.node_id AS source, b.node_id AS target FROM e a JOIN e b ON b.node_id = a.node_id + 11 WHERE a.t < 9 AND a.node_id % 7 = 0",
    "gd": "SELECT * FROM g WHERE target NOT IN (SELECT target FROM d) UNION ALL SELECT * FROM d",
    "p": """SELECT dataset, node_id + 1000000 AS node_id, t, z + ((node_id * 3) % 11 - 5) / 100.0 AS z, y + ((node_id * 5) % 11 - 5) / 100.0 AS y,
      x + ((node_id * 7) % 11 - 5) / 100.0 AS x FROM e WHERE node_id % 11 <> 0""",
    "pe": """SELECT DISTINCT dataset, source + 1000000 AS source, target + 1000000 AS target FROM (
        SELECT * FROM gd WHERE source % 13 <> 0 UNION ALL SELECT a.dataset, a.node_id, b.node_id FROM e a JOIN e b ON b.node_id = a.node_id + 21 WHERE a.t < 9 AND a.node_id % 17 = 0)
      WHERE source % 11 <> 0 AND target % 11 <> 0""",
    "m": """SELECT p.dataset, p.node_id AS pred_id, e.node_id AS gt_id FROM p JOIN e ON p.t = e.t AND
      sqrt((p.z - e.z) * (p.z - e.z) + (p.y - e.y) * (p.y - e.y) + (p.x - e.x) * (p.x - e.x)) <= 0.25""",
    "se": """SELECT * FROM (SELECT a.dataset, a.node_id AS source, b.node_id AS target, a.t, ((a.node_id * 31 + b.node_id * 17) % 97) / 97.0 AS probability,
      sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS distance FROM e a JOIN e b ON b.t = a.t + 1) WHERE distance <= 30""",
    "u": """SELECT 'U' AS dataset, user_id * 100 + t AS node_id, CAST(t AS INTEGER) AS t, z, y, x, user_id FROM (
      SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, avg(value) / 10 AS z, CAST(count(*) AS DOUBLE) AS y, max(value) / 10 AS x FROM events GROUP BY 1, 2)""",
    "l": "SELECT DISTINCT 'L' AS dataset, CAST(l_orderkey AS BIGINT) AS source, CAST(-(l_orderkey * 10 + l_linenumber) AS BIGINT) AS target FROM lineitem",
    "v": """SELECT 'V' || (vec_id // 36) AS dataset, CAST((vec_id // 18) % 2 AS INTEGER) AS c, CAST((vec_id // 6) % 3 AS INTEGER) AS t, CAST(vec_id % 6 AS INTEGER) AS z,
      CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, round_even(CAST(embedding[i + 1] AS DOUBLE) * 200, 0) + 50 AS value FROM embeddings, range(64) r(i)""",
    "cs": """SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS epoch, event_type AS checkpoint, 'fold_' || (user_id % 2) AS fold,
      round(avg(value) / 500, 9) AS score FROM events GROUP BY 1, 2, 3""",
}
_NEEDS = {"g": "e", "d": "e", "gd": "g d", "p": "e", "pe": "gd", "m": "p e", "se": "e"}


def with_tables(names: str, body: str, recursive: bool = False) -> str:
    """A DuckDB query: the named tables, what they need, then ``body`` (which may go on with more tables)."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in _NEEDS.get(name, "").split():
            add(x)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    head = ", ".join(f"{x} AS ({SQL[x]})" for x in order)
    body = body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{' ' if body.upper().startswith('SELECT') else ', '}{body}"

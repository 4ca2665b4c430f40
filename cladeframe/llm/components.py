"""Connected components of an edge table by alternating star contraction.

Each round replaces the edges by stars around smaller neighbours (large star,
then small star); the table never grows beyond the number of edges plus nodes
and no neighbourhood is ever collected: only per-node minima are aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.tables import discard, fewer, materialize


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Connect every neighbour (larger: strictly larger ones) of u to u's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(low, "a")
    if larger:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, a: str, b: str, name: str, rows: int | None = None) -> DataFrame:
    """(node, root): root is the smallest node of the component; only nodes that have an edge.

    With ``rows``, the number of edges, the tables between rounds get as many partitions as they need.
    """
    dealt = (lambda df: df) if rows is None else (lambda df: fewer(df, 2 * rows))  # stars have no more edges than edges and nodes
    now = materialize(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter(F.col("a") != F.col("b")), f"{name}-cc")
    said = None
    while True:
        then = materialize(dealt(_star(_star(now, True), False)), f"{name}-cc")
        now_said = then.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(now)
        now = then
        if now_said == said:
            break
        said = now_said
    members = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    members = materialize(dealt(members.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())), f"{name}-roots")
    discard(now)
    return members

"""Consensus of several predicted graphs."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.assign import first_come
from cladeframe.operators.graph import components
from cladeframe.operators.spatial import radius_join
from cladeframe.scratch import by_task, stored


def stack(graphs: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all graphs with the graph's number."""
    nodes = [n.select("dataset", "node_id", "t", "z", "y", "x", F.lit(i).alias("graph")) for i, (n, _) in enumerate(graphs)]
    edges = [e.select("dataset", "source", "target", F.lit(i).alias("graph")) for i, (_, e) in enumerate(graphs)]
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, edges)


def apart(nodes: DataFrame, radius: float) -> DataFrame:
    """``nodes`` with ``_part``: points of one frame in different parts can neither share a cluster nor change each other's.

    A cluster has at most one point a graph.  Its k-th point lies within
    ``radius`` of the mean of the others, so the mean moves by ``radius / k`` at
    most, and no point of k is further from it than
    ``radius (1/2 + ... + 1/k)``.  A point that a cluster of one graph less
    than there are can take is thus within ``radius (1 + 1/2 + ... + 1/(graphs - 1))``
    of each of its points; parts are what such distances connect.
    """
    nodes = stored(nodes, "cluster-points")
    graphs = nodes.select("graph").distinct().count()
    reach = radius * sum(1.0 / k for k in range(1, max(graphs, 2))) * (1 + 1e-9)
    name = (F.col("graph").cast("bigint") * 10**12 + F.col("node_id")).alias("node_id")
    points = nodes.select("dataset", "t", name, *(F.col(a).cast("double").alias(a) for a in "zyx"))
    near = radius_join(points, points, reach, 0, (1.0, 1.0, 1.0)).filter("left_id < right_id")
    united = components(points.select("dataset", "node_id").distinct(), near.select("dataset", F.col("left_id").alias("source"), F.col("right_id").alias("target")))
    part = united.select("dataset", F.col("node_id").alias("_name"), F.col("component").alias("_part"))
    return nodes.withColumn("_name", name).join(by_task(part), ["dataset", "_name"], "left").drop("_name")


def cluster(nodes: DataFrame, radius: float = 3.5) -> DataFrame:
    """dataset, t, graph, node_id, cluster: per frame each point joins the nearest cluster mean within ``radius`` that has no point of its graph.

    Points come in the order of graph, then id; of equal distances the later
    cluster wins; the cluster is named by its first point.  Every part of a
    frame (see :func:`apart`) is a group of its own.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["graph", "node_id"])
        sums: list[list[float]] = []
        count: list[int] = []
        graphs: list[set] = []
        first: list[int] = []
        at_cell: dict[tuple[int, int, int], set[int]] = {}  # running means by grid cells as wide as the radius
        cell_of: list[tuple[int, int, int]] = []
        out = []
        for r in pdf.itertuples(index=False):
            best, at = radius, -1
            home = tuple(math.floor(v / radius) for v in (r.z, r.y, r.x))
            near = sorted(i for o in itertools.product((-1, 0, 1), repeat=3) for i in at_cell.get(tuple(a + b for a, b in zip(home, o)), ()))
            for i in near:
                if r.graph in graphs[i]:
                    continue
                k = count[i]
                d = ((r.z - sums[i][0] / k) ** 2 + (r.y - sums[i][1] / k) ** 2 + (r.x - sums[i][2] / k) ** 2) ** 0.5
                if d <= best:
                    best, at = d, i
            if at < 0:
                at = len(sums)
                sums.append([0.0, 0.0, 0.0])
                count.append(0)
                graphs.append(set())
                if not 0 <= r.node_id < 10**12:
                    raise ValueError("ids of stacked graphs are below 10^12")
                first.append(r.graph * 10**12 + r.node_id)
                cell_of.append(home)
                at_cell.setdefault(home, set()).add(at)
            for a, v in enumerate((r.z, r.y, r.x)):
                sums[at][a] += v
            count[at] += 1
            moved = tuple(math.floor(v / count[at] / radius) for v in sums[at])
            if moved != cell_of[at]:
                at_cell[cell_of[at]].discard(at)
                at_cell.setdefault(moved, set()).add(at)
                cell_of[at] = moved
            graphs[at].add(r.graph)
            out.append((r.dataset, r.t, r.graph, r.node_id, first[at]))
        return pd.DataFrame(out, columns=["dataset", "t", "graph", "node_id", "cluster"])

    return apart(nodes, radius).groupBy("dataset", "t", "_part").applyInPandas(run, "dataset string, t int, graph int, node_id bigint, cluster bigint")


def edge_votes(edges: DataFrame, members: DataFrame) -> DataFrame:
    """dataset, source, target (clusters), votes: how many graphs' edges lead from one cluster to another."""
    s = members.select("dataset", "graph", F.col("node_id").alias("source"), F.col("cluster").alias("cs"), F.col("t").alias("ts"))
    t = members.select("dataset", "graph", F.col("node_id").alias("target"), F.col("cluster").alias("ct"), F.col("t").alias("tt"))
    both = edges.join(by_task(s), ["dataset", "graph", "source"]).join(by_task(t), ["dataset", "graph", "target"]).filter("cs <> ct AND tt > ts")
    return both.groupBy("dataset", F.col("cs").alias("source"), F.col("ct").alias("target")).agg(F.count(F.lit(1)).alias("votes"))


def consensus(graphs: list[tuple[DataFrame, DataFrame]], radius: float = 3.5, min_node_votes: int = 1, min_edge_votes: int = 1) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that enough graphs agree on; contested edges go to more votes, then to the shorter one.

    A node may have two children only if some graph's node in its cluster has
    two, and one parent.
    """
    nodes, edges = stack(graphs)
    members = stored(cluster(nodes, radius), "members")
    full = members.join(by_task(nodes), ["dataset", "t", "graph", "node_id"])
    points = full.groupBy("dataset", F.col("cluster").alias("node_id"), "t").agg(
        F.count(F.lit(1)).alias("votes"), *(F.avg(a).alias(a) for a in "zyx")
    ).filter(F.col("votes") >= min_node_votes)
    kept = members.join(by_task(points.select("dataset", F.col("node_id").alias("cluster"))), ["dataset", "cluster"], "left_semi").select(*members.columns)
    votes = edge_votes(edges, kept).filter(F.col("votes") >= min_edge_votes)
    out = edges.groupBy("dataset", "graph", F.col("source").alias("node_id")).agg(F.count(F.lit(1)).alias("k"))
    room = kept.join(by_task(out), ["dataset", "graph", "node_id"], "left").groupBy("dataset", F.col("cluster").alias("source")).agg(
        F.least(F.lit(2), F.greatest(F.lit(1), F.coalesce(F.max("k"), F.lit(1)))).cast("int").alias("room")
    )
    at = lambda key, p: points.select("dataset", F.col("node_id").alias(key), *(F.col(a).alias(p + a) for a in "zyx"))
    ranked = votes.join(by_task(at("source", "s")), ["dataset", "source"]).join(by_task(at("target", "t")), ["dataset", "target"]).join(by_task(room), ["dataset", "source"])
    d = F.sqrt(sum(((F.col("s" + a) - F.col("t" + a)) * (F.col("s" + a) - F.col("t" + a)) for a in "zyx"), F.lit(0.0)))
    ranked = ranked.select("dataset", "source", "target", "votes", d.alias("distance"), "room", (-F.col("votes")).alias("_v"))

    order = [F.col(c) for c in ("_v", "distance", "source", "target")]
    taken = first_come(ranked, order, [("source", "source", F.col("room")), ("target", "target", 1)])
    return points, taken.select("dataset", "source", "target", "votes", "distance")

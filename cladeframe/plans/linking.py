"""Queries on linking, repair and consensus; their order-dependent parts are tested in ``tests``."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import assign as S
from cladeframe.operators import ensemble as C
from cladeframe.operators import flow as W
from cladeframe.operators import repair as R
from cladeframe.operators import track as K
from cladeframe.operators.graph import open_ends
from cladeframe.plans.registry import query
from cladeframe.sources import adapters as A
from cladeframe.sources.adapters import with_tables


def _n(spark, d):
    return A.nodes(spark, d).drop("label")


def _broken(n):
    """Forest edges with every sixth source cut off, with probability and length."""
    from cladeframe.operators.graph import length, with_ends

    e = A.forest_edges(n).filter("source % 6 <> 0")
    return with_ends(e, n).select("dataset", "source", "target", ((F.col("source") % 10) / 10.0).alias("probability"), length().alias("distance"))


@query()
def as2_link(spark, d):
    return K.link(_n(spark, d)).withColumn("distance", F.round("distance", 6))


@query()
def as3_link_symmetric(spark, d):
    return K.link(_n(spark, d), tau=0.6).filter("kind = 'division'").withColumn("distance", F.round("distance", 6))


@query()
def as4_track(spark, d):
    return K.track(_n(spark, d)).withColumn("distance", F.round("distance", 6))


def _round(df):
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query()
def as5_motion_relink(spark, d):
    n = _n(spark, d)
    return _round(K.relink(n, A.scored_edges(n).filter("distance <= 20"), 8.0, 20.0))  # pairs beyond both gates are never asked for


@query()
def as6_flow_relink(spark, d):
    return _round(K.relink(_n(spark, d), None, 12.0, 25.0, flow={"k": 12, "radius": 40.0, "exclude": 1.5, "least": 4, "rounds": 1}))


def _graph_rows(graph):
    n, e = graph
    a = n.select("dataset", F.lit("node").alias("kind"), F.col("node_id").alias("a"), F.col("t").cast("bigint").alias("b"))
    return a.unionByName(e.select("dataset", F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query()
def as7_close_gaps(spark, d):
    n = _n(spark, d)
    return _graph_rows(R.close_gaps(n, _broken(n), 20.0, 6.0))


@query()
def as8_close_gaps_assigned(spark, d):
    n = _n(spark, d)
    return _graph_rows(R.close_gaps_assigned(n, _broken(n), 20.0, 6.0))


@query()
def as9_long_gaps(spark, d):
    n = _n(spark, d)
    e = _broken(n)
    return _graph_rows(R.fill_long_gaps(n, e, R.long_gap_proposals(n, e, 2, 30.0, 12.0, -1.1, 200.0)))


@query()
def as10_fill_from_pool(spark, d):
    n = _n(spark, d)
    pool = A.predicted_nodes(A.nodes(spark, d)).withColumn("score", F.lit(0.9))
    return _graph_rows(R.fill_from_pool(n, _broken(n), pool, 2, 0.5, 15.0, 10.0))


@query()
def as11_safe_divisions(spark, d):
    n = _n(spark, d)
    e = A.chain_edges(n).filter("source % 4 <> 1")
    return R.add_divisions(n, e, R.division_proposals(n, e, 20.0, 30.0, 1.0, 0.9), 0.01, 0.05)


def _graphs(spark, d):
    base = A.nodes(spark, d)
    n, e = base.drop("label"), A.forest_edges(base)
    q = A.predicted_nodes(base)
    moved = n.select("dataset", "node_id", "t", (F.col("z") + 0.4).alias("z"), "y", (F.col("x") - 0.3).alias("x")).filter("node_id % 9 <> 4")
    kept = e.filter("source % 9 <> 4 AND target % 9 <> 4")
    return [(n, e), (q, A.predicted_edges(base)), (moved, kept)]


@query()
def as12_consensus_clusters(spark, d):
    return C.cluster(C.stack(_graphs(spark, d))[0])


@query(with_tables("e gd pe p", """st AS (SELECT 0 AS graph, source, target FROM gd UNION ALL SELECT 1, source - 1000000, target - 1000000 FROM pe UNION ALL SELECT 2, source, target FROM gd WHERE source % 9 <> 4 AND target % 9 <> 4)
  SELECT 'E' AS dataset, source, target, count(*) AS votes FROM st JOIN e a ON a.node_id = source JOIN e b ON b.node_id = target WHERE b.t > a.t GROUP BY source, target"""))
def as13_edge_votes(spark, d):
    """Votes with the clusters given: each point stands for the true point it was made from."""
    nodes, edges = C.stack(_graphs(spark, d))
    members = nodes.select("dataset", "t", "graph", "node_id", (F.col("node_id") % A.SHIFT).alias("cluster"))
    return C.edge_votes(edges, members)


@query()
def as14_consensus(spark, d):
    points, edges = C.consensus(_graphs(spark, d), min_node_votes=2, min_edge_votes=2)
    return _graph_rows((points, edges))


@query()
def as15_largest_matching(spark, d):
    n = _n(spark, d)
    return S.pair_up_points(n, n, 1, 15.0).groupBy("dataset").agg(F.count(F.lit(1)).alias("pairs"))


@query(with_tables("e gd", """broken AS (SELECT * FROM gd WHERE source % 6 <> 0),
  pr AS (SELECT *, row_number() OVER (ORDER BY d, s, g) AS k FROM (SELECT a.dataset, a.t, a.node_id AS s, b.node_id AS g, sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d
    FROM e a JOIN e b ON b.t = a.t + 1 WHERE a.node_id NOT IN (SELECT source FROM broken) AND b.node_id NOT IN (SELECT target FROM broken)) WHERE d <= 20),
  w AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS us, []::BIGINT[] AS ug, FALSE AS free
    UNION ALL SELECT k, CASE WHEN free THEN list_append(us, s) ELSE us END, CASE WHEN free THEN list_append(ug, g) ELSE ug END, free
      FROM (SELECT pr.k, us, ug, s, g, NOT list_contains(us, s) AND NOT list_contains(ug, g) AS free FROM w JOIN pr ON pr.k = w.k + 1))
  SELECT dataset, t, s AS left_id, g AS right_id, round(d, 6) AS distance FROM w JOIN pr USING (k) WHERE free""", recursive=True))
def as17_fragments(spark, d):
    n = _n(spark, d)
    ends, starts = open_ends(n, _broken(n))
    return _round(R.fragments(ends, starts, 20.0, 1))


@query()
def as20_ungated_then_cut(spark, d):
    n = _n(spark, d)
    return _round(S.ungated_then_cut(n, n, 10.0))


@query()
def rk6_short_tracks(spark, d):
    n = _n(spark, d)
    return R.short_tracks(n, _broken(n), 6, 3, 0.3, 60.0, 0.05, 40).select("dataset", "node_id")


@query(with_tables("e g", """c AS (SELECT * FROM g WHERE source % 4 <> 1), one AS (SELECT source, min(target) AS next FROM c GROUP BY source HAVING count(*) = 1),
  pr AS (SELECT a.node_id AS source, a.node_id + 1 AS child, b.node_id AS candidate FROM e a JOIN e k ON k.node_id = a.node_id + 1 JOIN e b ON b.t = a.t + 1 AND b.node_id = a.node_id + 31 WHERE a.t < 9),
  w AS (SELECT source, child, candidate, child AS p, candidate AS q, 0 AS k FROM pr
    UNION ALL SELECT w.source, child, candidate, x.next, y.next, k + 1 FROM w JOIN e a ON a.node_id = p JOIN e b ON b.node_id = q JOIN one x ON x.source = p JOIN one y ON y.source = q
      WHERE k < 2 AND sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) < 28)
  SELECT DISTINCT 'E' AS dataset, w.source, child, candidate FROM w JOIN e a ON a.node_id = p JOIN e b ON b.node_id = q WHERE sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) >= 28""", recursive=True))
def as11b_diverging_later(spark, d):
    n = _n(spark, d)
    later = n.select("dataset", F.col("node_id").alias("candidate"))
    props = n.filter("t < 9").select("dataset", F.col("node_id").alias("source"), (F.col("node_id") + 1).alias("child"), (F.col("node_id") + 31).alias("candidate")).join(later, ["dataset", "candidate"], "left_semi")
    return R.diverging_later(n, A.chain_edges(n).filter("source % 4 <> 1"), props.select("dataset", "source", "child", "candidate"), 28.0, 2)


@query()
def as19_mend(spark, d):
    n = _n(spark, d)
    return _graph_rows(R.mend(n, _broken(n), 20.0, 6.0))


@query()
def as16_least_cost_graph(spark, d):
    n = _n(spark, d)
    return _graph_rows(W.solve(n, A.scored_edges(n).filter("distance <= 20")))

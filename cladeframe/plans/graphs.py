"""Queries on the structure of graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import graph as G
from cladeframe.plans.registry import query
from cladeframe.sources import adapters as A
from cladeframe.sources.adapters import with_tables

ROUND = "round({0}, 6) AS {0}"
CLOSURE = """pairs AS (SELECT source AS a, target AS b FROM {edges} UNION SELECT target, source FROM {edges}),
  reach AS (SELECT node_id AS a, node_id AS b FROM {nodes} UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
  comp AS (SELECT a AS node_id, min(b) AS component FROM reach GROUP BY a)"""


@query(with_tables("e", "SELECT dataset, t, count(*) AS n FROM e GROUP BY 1, 2"))
def ag1_nodes_per_frame(spark, d):
    return G.per_frame(A.nodes(spark, d))


@query(with_tables("u", "SELECT dataset, t, count(*) AS n FROM u GROUP BY 1, 2"))
def ag1_user_days(spark, d):
    return G.per_frame(A.user_days(spark, d))


@query(with_tables("e gd", """SELECT e.dataset, e.node_id, (SELECT count(*) FROM gd WHERE gd.source = e.node_id) AS out_degree,
  (SELECT count(*) FROM gd WHERE gd.target = e.node_id) AS in_degree FROM e"""))
def ag2_degrees(spark, d):
    n = A.nodes(spark, d)
    return G.degrees(n, A.forest_edges(n))


@query(with_tables("l", "SELECT dataset, source AS node_id, count(*) AS out_degree FROM l GROUP BY 1, 2 HAVING count(*) >= 2"))
def ag3_order_forks(spark, d):
    return G.forks(A.order_forks(spark, d))


@query(with_tables("pe", "SELECT dataset, target, CAST(list_sort(list_distinct(list(source))) AS VARCHAR) AS sources FROM pe GROUP BY 1, 2"))
def ag4_sources_of_target(spark, d):
    df = G.neighbours(A.predicted_edges(A.nodes(spark, d)), "target", "source")
    return df.select("dataset", "target", F.concat(F.lit("["), F.array_join(F.transform("sources", lambda x: x.cast("string")), ", "), F.lit("]")).alias("sources"))


@query(with_tables("e gd", CLOSURE.format(edges="gd", nodes="e") + " SELECT 'E' AS dataset, node_id, component FROM comp", recursive=True))
def ag5_components(spark, d):
    n = A.nodes(spark, d)
    return G.components(n, A.forest_edges(n))


@query(with_tables("e gd", CLOSURE.format(edges="gd", nodes="e") + """, f AS (SELECT source FROM gd GROUP BY 1 HAVING count(*) > 1)
  SELECT 'E' AS dataset, component, count(*) AS size, bool_or(node_id IN (SELECT source FROM f)) AS has_division,
  round(avg((node_id % 10) / 10.0), 6) AS mean_confidence FROM comp GROUP BY component""", recursive=True))
def ag6_component_stats(spark, d):
    n = A.nodes(spark, d)
    e = A.forest_edges(n)
    conf = n.select("dataset", "node_id", ((F.col("node_id") % 10) / 10.0).alias("confidence"))
    return G.component_stats(G.components(n, e), e, conf).withColumn("mean_confidence", F.round("mean_confidence", 6))


@query(with_tables("e gd", """parents AS (SELECT e.node_id, max(gd.source) AS parent_id FROM e LEFT JOIN gd ON gd.target = e.node_id GROUP BY 1)
  SELECT 'E' AS dataset, parent_id AS source, node_id AS target FROM parents WHERE parent_id IS NOT NULL"""))
def src4_from_parents(spark, d):
    n = A.nodes(spark, d)
    parent = A.forest_edges(n).groupBy("dataset", F.col("target").alias("node_id")).agg(F.max("source").alias("parent_id"))
    return G.from_parents(n.join(parent, ["dataset", "node_id"], "left"))[1]


@query(with_tables("e pe", """bad AS (SELECT 'E' AS dataset, source - 1000000 AS source, target - 1000000 AS target FROM pe
    UNION ALL SELECT 'E', node_id, node_id - 1 FROM e WHERE node_id % 50 = 9 UNION ALL SELECT 'E', node_id, node_id + 5000000 FROM e WHERE node_id % 90 = 0),
  n2 AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE node_id % 100 = 3)
  SELECT dataset, 'duplicate_node' AS rule, node_id AS id FROM n2 GROUP BY 1, 3 HAVING count(*) > 1
  UNION ALL SELECT dataset, 'dangling_edge', id FROM (SELECT dataset, source AS id FROM bad UNION SELECT dataset, target FROM bad) WHERE id NOT IN (SELECT node_id FROM e)
  UNION ALL SELECT bad.dataset, 'backward_edge', source FROM bad JOIN n2 a ON a.node_id = source JOIN n2 b ON b.node_id = target WHERE b.t <= a.t"""))
def graph_violations(spark, d):
    n = A.nodes(spark, d)
    e = A.predicted_edges(n).select("dataset", (F.col("source") - A.SHIFT).alias("source"), (F.col("target") - A.SHIFT).alias("target"))
    back = n.filter("node_id % 50 = 9").select("dataset", F.col("node_id").alias("source"), (F.col("node_id") - 1).alias("target"))
    loose = n.filter("node_id % 90 = 0").select("dataset", F.col("node_id").alias("source"), (F.col("node_id") + 5000000).alias("target"))
    return G.violations(n.unionByName(n.filter("node_id % 100 = 3")), e.unionByName(back).unionByName(loose))


ENDS = """ends AS (SELECT pe.*, a.t AS ta, b.t AS tb, sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS distance
    FROM pe JOIN p a ON a.node_id = pe.source JOIN p b ON b.node_id = pe.target)"""


@query(with_tables("p pe", ENDS + " SELECT dataset, source, target, round(distance, 6) AS distance FROM ends WHERE tb = ta + 1 AND distance <= 28"))
def flt1_edge_filter(spark, d):
    n = A.nodes(spark, d)
    return G.filter_edges(A.predicted_nodes(n), A.predicted_edges(n), 28.0).withColumn("distance", F.round("distance", 6))


BEST = """SELECT dataset, source, target, round(probability, 6) AS probability FROM (SELECT *, row_number() OVER (PARTITION BY {0} ORDER BY probability DESC, distance, source, target) AS r FROM se) WHERE r <= {1}"""


@query(with_tables("se", BEST.format("target", 1)))
def rk3_best_parent(spark, d):
    return G.best_by(A.scored_pairs(A.nodes(spark, d)), "target").select("dataset", "source", "target", F.round("probability", 6).alias("probability"))


@query(with_tables("se", BEST.format("source", 2)))
def rk3_best_children(spark, d):
    return G.best_by(A.scored_pairs(A.nodes(spark, d)), "source", k=2).select("dataset", "source", "target", F.round("probability", 6).alias("probability"))


@query(with_tables("e pe", """SELECT dataset, node_id FROM (SELECT *, row_number() OVER (ORDER BY -(node_id % 37), CAST(node_id AS VARCHAR)) AS r FROM e) WHERE r <= 100"""))
def rk4_node_budget(spark, d):
    n = A.nodes(spark, d).withColumn("score", (F.col("node_id") % 37).cast("double"))
    return G.node_budget(n, 100, "score").select("dataset", "node_id")


@query(with_tables("e", """top AS (SELECT node_id FROM (SELECT *, row_number() OVER (ORDER BY -(node_id % 37), CAST(node_id AS VARCHAR)) AS r FROM e) WHERE r <= 200),
  g AS (SELECT a.node_id AS source, b.node_id AS target FROM e a JOIN e b ON b.node_id = a.node_id + 1 WHERE a.t < 9)
  SELECT 'E' AS dataset, source, target FROM g WHERE source IN (SELECT node_id FROM top) AND target IN (SELECT node_id FROM top)"""))
def rk4_induced_edges(spark, d):
    n = A.nodes(spark, d).withColumn("score", (F.col("node_id") % 37).cast("double"))
    return G.induced(A.chain_edges(n), G.node_budget(n, 200, "score"))


@query(with_tables("e gd", """cut AS (SELECT * FROM gd WHERE source % 5 <> 0), """ + CLOSURE.format(edges="cut", nodes="e") + """,
  s AS (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 6 OR avg((node_id % 10) / 10.0) >= 0.69)
  SELECT 'E' AS dataset, node_id FROM comp WHERE component IN (SELECT component FROM s)""", recursive=True))
def rk5_short_components(spark, d):
    n = A.nodes(spark, d)
    conf = n.select("dataset", "node_id", ((F.col("node_id") % 10) / 10.0).alias("confidence"))
    return G.short_components(n, A.forest_edges(n).filter("source % 5 <> 0"), 6, confidence=conf, exempt=0.69).select("dataset", "node_id")


@query(with_tables("e gd", """cut AS (SELECT * FROM gd WHERE source % 5 <> 0), """ + CLOSURE.format(edges="cut", nodes="e") + """,
  f AS (SELECT source FROM cut GROUP BY 1 HAVING count(*) > 1),
  s AS (SELECT component FROM comp GROUP BY 1 HAVING count(*) >= 6 OR bool_or(node_id IN (SELECT source FROM f)))
  SELECT 'E' AS dataset, node_id FROM comp WHERE component IN (SELECT component FROM s)""", recursive=True))
def rk6_long_or_dividing(spark, d):
    n = A.nodes(spark, d)
    return G.short_components(n, A.forest_edges(n).filter("source % 5 <> 0"), 6, keep_divisions=True).select("dataset", "node_id")


@query(with_tables("se e", """two AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY probability DESC, distance, source, target) AS r FROM se),
  pair AS (SELECT a.source FROM two a JOIN two b ON a.source = b.source AND a.r = 1 AND b.r = 2 JOIN e p ON p.node_id = a.target JOIN e q ON q.node_id = b.target
    WHERE a.distance <= 25 AND b.distance <= 25 AND sqrt((p.z - q.z) * (p.z - q.z) + (p.y - q.y) * (p.y - q.y) + (p.x - q.x) * (p.x - q.x)) <= 30)
  SELECT dataset, source, target FROM two WHERE r = 1 OR r = 2 AND source IN (SELECT source FROM pair)"""))
def rk7_division_geometry(spark, d):
    n = A.nodes(spark, d)
    return G.division_geometry(n, A.scored_pairs(n), 25.0, 30.0).select("dataset", "source", "target")


@query(with_tables("e g", """cut AS (SELECT * FROM g WHERE source % 3 = 0) SELECT dataset, node_id FROM e WHERE node_id IN (SELECT source FROM cut UNION SELECT target FROM cut)"""))
def rk8_drop_isolated(spark, d):
    n = A.nodes(spark, d)
    return G.drop_isolated(n, A.chain_edges(n).filter("source % 3 = 0")).select("dataset", "node_id")


@query(with_tables("e gd", """s AS (SELECT *, CASE WHEN source % 4 = 0 THEN NULL ELSE (source % 10) / 10.0 END AS probability FROM gd)
  SELECT dataset, node_id FROM e WHERE NOT (node_id NOT IN (SELECT source FROM s) AND (SELECT count(*) FROM s WHERE target = node_id) = 1
    AND t < 9 AND coalesce((SELECT max(probability) FROM s WHERE target = node_id) < 0.6, FALSE))"""))
def rk9_weak_leaves(spark, d):
    n = A.nodes(spark, d)
    e = A.forest_edges(n).withColumn("probability", F.when(F.col("source") % 4 != 0, (F.col("source") % 10) / 10.0))
    return G.weak_leaves(n, e, 0.6).select("dataset", "node_id")


@query(with_tables("se", """short AS (SELECT * FROM se WHERE distance <= 14), one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY probability DESC, distance, source, target) AS r FROM short) WHERE r = 1),
  two AS (SELECT dataset, source, target FROM (SELECT * EXCLUDE (r), row_number() OVER (PARTITION BY source ORDER BY probability DESC, distance, source, target) AS r FROM one) WHERE r <= 2)
  SELECT * FROM two"""))
def as18_fallback_graph(spark, d):
    n = A.nodes(spark, d)
    return G.fallback(n, A.scored_pairs(n))[1].select("dataset", "source", "target")


@query(with_tables("u", "f AS (SELECT DISTINCT dataset, t FROM u) SELECT * FROM (SELECT dataset, t AS t0, lead(t) OVER (PARTITION BY dataset ORDER BY t) AS t1 FROM f) WHERE t1 IS NOT NULL"))
def wn1_frame_pairs(spark, d):
    return G.frame_pairs(A.user_days(spark, d))


UEDGES = """ue AS (SELECT * FROM (SELECT dataset, node_id AS source, lead(node_id) OVER (PARTITION BY user_id ORDER BY t) AS target FROM u) WHERE target IS NOT NULL)"""


def _user_edges(u):
    from pyspark.sql import Window

    w = Window.partitionBy("dataset", "user_id").orderBy("t")
    return u.select("dataset", F.col("node_id").alias("source"), F.lead("node_id").over(w).alias("target")).filter("target IS NOT NULL")


@query(with_tables("u", UEDGES + """ SELECT ue.dataset, source, target, round((b.z - a.z) / (b.t - a.t), 6) AS vz, round((b.y - a.y) / (b.t - a.t), 6) AS vy, round((b.x - a.x) / (b.t - a.t), 6) AS vx
  FROM ue JOIN u a ON a.node_id = source JOIN u b ON b.node_id = target"""))
def wn2_velocities(spark, d):
    u = A.user_days(spark, d)
    return G.velocities(u, _user_edges(u)).select("dataset", "source", "target", *(F.round(c, 6).alias(c) for c in ("vz", "vy", "vx")))


@query(with_tables("u", """o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM u),
  w AS (SELECT a.dataset, a.node_id, a.t, a.y, count(*) AS n, regr_intercept(b.y, CAST(b.t - a.t AS DOUBLE)) AS f FROM o a JOIN o b ON a.user_id = b.user_id AND abs(a.i - b.i) <= 2 GROUP BY ALL)
  SELECT dataset, node_id, round(CASE WHEN n >= 3 THEN 0.2 * y + 0.8 * f ELSE y END, 6) AS y FROM w"""))
def wn4_line_fit(spark, d):
    u = A.user_days(spark, d)
    return G.smooth(u, _user_edges(u)).select("dataset", "node_id", F.round("y", 6).alias("y"))


@query(with_tables("u", UEDGES + """, gaps AS (SELECT ue.*, a.t AS ta, b.t - a.t - 1 AS g, a.z AS az, b.z AS bz FROM ue JOIN u a ON a.node_id = source JOIN u b ON b.node_id = target WHERE b.t - a.t > 1)
  SELECT dataset, source, target, k, ta + k AS t, round(az + (bz - az) * k / (g + 1), 6) AS z FROM (SELECT *, unnest(range(1, CAST(g + 1 AS BIGINT))) AS k FROM gaps)"""))
def wn5_interpolate(spark, d):
    u = A.user_days(spark, d)
    gaps = G.with_ends(_user_edges(u), u).withColumn("g", F.col("t_t") - F.col("s_t") - 1).filter("g > 0")
    return G.interpolate(gaps).select("dataset", "source", "target", F.col("k").cast("bigint").alias("k"), F.col("t").cast("bigint").alias("t"), F.round("z", 6).alias("z"))


@query(with_tables("u", UEDGES + """, v AS (SELECT ue.source, ue.target, (b.y - a.y) / (b.t - a.t) AS v, b.t FROM ue JOIN u a ON a.node_id = source JOIN u b ON b.node_id = target),
  walk AS (SELECT target, v AS ema FROM v WHERE source NOT IN (SELECT target FROM v) UNION ALL SELECT v.target, 0.5 * v.v + 0.5 * walk.ema FROM walk JOIN v ON v.source = walk.target)
  SELECT 'U' AS dataset, target AS node_id, round(ema, 6) AS ema FROM walk""", recursive=True))
def wn3_velocity_average(spark, d):
    """Exponential average of the step along every track, as one fold over the track's sorted steps."""
    u = A.user_days(spark, d)
    steps = G.velocities(u, _user_edges(u)).join(u.select("dataset", F.col("node_id").alias("target"), "user_id", "t"), ["dataset", "target"])
    runs = steps.groupBy("dataset", "user_id").agg(F.array_sort(F.collect_list(F.struct("t", "target", "vy"))).alias("s"))
    none = F.array().cast("array<struct<target:bigint,ema:double>>")
    ema = F.aggregate("s", none, lambda acc, x: F.concat(acc, F.array(F.struct(
        x["target"].alias("target"), F.when(F.size(acc) == 0, x["vy"]).otherwise(0.5 * x["vy"] + 0.5 * F.element_at(acc, -1)["ema"]).alias("ema")))))
    return runs.select("dataset", F.explode(ema).alias("e")).select("dataset", F.col("e.target").alias("node_id"), F.round("e.ema", 6).alias("ema"))


@query(with_tables("e p", "SELECT dataset, t FROM e UNION SELECT dataset, t + 5 FROM p"))
def st1_frame_union(spark, d):
    n = A.nodes(spark, d)
    return n.select("dataset", "t").union(A.predicted_nodes(n).select("dataset", (F.col("t") + 5).alias("t"))).distinct()


@query(with_tables("e", """a AS (SELECT DISTINCT label FROM e WHERE node_id % 3 = 0), b AS (SELECT DISTINCT label FROM e WHERE node_id % 5 = 1)
  SELECT label, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT label, 'first' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
  UNION ALL SELECT label, 'second' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"""))
def st2_dataset_coverage(spark, d):
    n = A.nodes(spark, d)
    a, b = n.filter("node_id % 3 = 0").select("label").distinct(), n.filter("node_id % 5 = 1").select("label").distinct()
    side = lambda df, s: df.withColumn("side", F.lit(s))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "first")).unionByName(side(b.subtract(a), "second"))


@query(with_tables("gd pe", "SELECT dataset, source, target FROM gd EXCEPT SELECT dataset, source - 1000000, target - 1000000 FROM pe"))
def st3_missed_edges(spark, d):
    n = A.nodes(spark, d)
    back = A.predicted_edges(n).select("dataset", (F.col("source") - A.SHIFT).alias("source"), (F.col("target") - A.SHIFT).alias("target"))
    return A.forest_edges(n).subtract(back)


@query("SELECT (SELECT count(*) FROM (SELECT DISTINCT source FROM documents WHERE lang = 'de' EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'fr')) = 0 AND (SELECT count(*) FROM (SELECT DISTINCT source FROM documents WHERE lang = 'fr' EXCEPT SELECT DISTINCT source FROM documents WHERE lang = 'de')) = 0 AS equal")
def st4_same_sets(spark, d):
    docs = A.read(spark, d, "documents")
    a, b = (docs.filter(F.col("lang") == x).select("source").distinct() for x in ("de", "fr"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count(F.lit(1)) == 0).alias("equal"))


@query(with_tables("e", """f AS (SELECT DISTINCT label, CASE WHEN node_id % 3 = 0 THEN 'train' ELSE 'test' END AS part FROM e) SELECT a.label AS shared FROM f a JOIN f b ON a.label = b.label AND a.part = 'train' AND b.part = 'test'"""))
def st5_overlap(spark, d):
    n = A.nodes(spark, d)
    return n.filter("node_id % 3 = 0").select("label").intersect(n.filter("node_id % 3 <> 0").select("label")).withColumnRenamed("label", "shared")


@query(with_tables("g d", "SELECT dataset, source, target, 'chain' AS log FROM g UNION ALL SELECT dataset, source, target, 'split' FROM d"))
def st6_concatenate(spark, d):
    n = A.nodes(spark, d)
    known = n.select("dataset", F.col("node_id").alias("target"))
    split = n.filter("t < 9 AND node_id % 7 = 0").select("dataset", F.col("node_id").alias("source"), (F.col("node_id") + 11).alias("target")).join(known, ["dataset", "target"], "left_semi")
    return A.chain_edges(n).withColumn("log", F.lit("chain")).unionByName(split.select("dataset", "source", "target").withColumn("log", F.lit("split")))

"""Queries on scalar and per-group functions."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cladeframe.functions import scalar as X
from cladeframe.plans.registry import query
from cladeframe.sources import adapters as A
from cladeframe.sources.adapters import with_tables

R6 = lambda c: F.round(c, 6)


@query(with_tables("e", "SELECT node_id, round(z * 1.625, 6) AS z, round(y * 0.40625, 6) AS y, round(x * 0.40625, 6) AS x FROM e"))
def prj1_scaling(spark, d):
    z, y, x = X.scale_position((F.col("z"), F.col("y"), F.col("x")), (1.625, 0.40625, 0.40625))
    return A.nodes(spark, d).select("node_id", R6(z).alias("z"), R6(y).alias("y"), R6(x).alias("x"))


@query(with_tables("e g", """SELECT source, target, round(sqrt((a.z - b.z) * 1.625 * ((a.z - b.z) * 1.625) + (a.y - b.y) * 0.40625 * ((a.y - b.y) * 0.40625)
  + (a.x - b.x) * 0.40625 * ((a.x - b.x) * 0.40625)), 6) AS distance FROM g JOIN e a ON a.node_id = source JOIN e b ON b.node_id = target"""))
def prj2_scaled_distance(spark, d):
    from cladeframe.operators.graph import length, with_ends

    n = A.nodes(spark, d)
    return with_ends(A.chain_edges(n), n).select("source", "target", R6(length(scale=(1.625, 0.40625, 0.40625))).alias("distance"))


@query(with_tables("e", """w AS (SELECT node_id, CASE WHEN node_id % 9 = 0 THEN 'bad' WHEN node_id % 9 = 1 THEN 'NaN' WHEN node_id % 9 = 2 THEN NULL ELSE CAST((node_id % 101) / 10.0 - 5 AS VARCHAR) END AS v FROM e),
  n AS (SELECT node_id, try_cast(v AS DOUBLE) AS v FROM w) SELECT node_id, round(CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN 0 WHEN v BETWEEN 0 AND 1 THEN v ELSE 1 / (1 + exp(-greatest(-20, least(20, v)))) END, 6) AS p FROM n"""))
def prj3_probability(spark, d):
    k = F.col("node_id")
    v = F.when(k % 9 == 0, "bad").when(k % 9 == 1, "NaN").when(k % 9 == 2, None).otherwise(((k % 101) / 10.0 - 5).cast("string"))
    return A.nodes(spark, d).select("node_id", R6(X.probability(v)).alias("p"))


_F, _B = "((node_id % 19) / 19.0)", "((node_id % 23) / 23.0)"
_C = "greatest({0}, 2.220446049250313e-16)"


@query(with_tables("e", f"""SELECT node_id, round(0.7 * {_F} + 0.3 * {_B}, 6) AS arithmetic, round(exp(0.7 * ln({_C.format(_F)}) + 0.3 * ln({_C.format(_B)})), 6) AS geometric,
  round(1 / (0.7 / {_C.format(_F)} + 0.3 / {_C.format(_B)}), 6) AS harmonic FROM e"""))
def prj4_fusion(spark, d):
    f, b = (F.col("node_id") % 19) / 19.0, (F.col("node_id") % 23) / 23.0
    return A.nodes(spark, d).select("node_id", *(R6(X.fuse(f, b, how, 0.3)).alias(how) for how in ("arithmetic", "geometric", "harmonic")))


@query(with_tables("e", """w AS (SELECT node_id, greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, (node_id % 21) / 20.0)) AS p FROM e)
  SELECT node_id, round(1 / (1 + exp(-(ln(p) - ln(1 - p)) / 1.7)), 6) AS p FROM w"""))
def prj5_temperature(spark, d):
    return A.nodes(spark, d).select("node_id", R6(X.temper((F.col("node_id") % 21) / 20.0, 1.7)).alias("p"))


@query(with_tables("e", "SELECT node_id, " + ", ".join(
    f"round({f}({c} * {w}), 6) AS e{i}" for i, (c, f, w) in enumerate((c, f, w) for c in ("t / 10.0", "z / 100.0") for f in ("sin", "cos") for w in (math.pi, 2 * math.pi))) + " FROM e"))
def prj6_positional_encoding(spark, d):
    enc = X.positional_encoding([F.col("t") / 10.0, F.col("z") / 100.0], [math.pi, 2 * math.pi])
    return A.nodes(spark, d).withColumn("e", enc).select("node_id", *(R6(F.col("e")[i]).alias(f"e{i}") for i in range(8)))


@query(with_tables("e v", """w AS (SELECT node_id, least(greatest(CAST(round_even(z / 10, 0) AS INTEGER), 0), 5) AS z, least(greatest(CAST(round_even(y / 10, 0) AS INTEGER), 0), 7) AS y, least(greatest(CAST(round_even(x / 10, 0) AS INTEGER), 0), 7) AS x FROM e)
  SELECT node_id, v.value FROM w JOIN v ON v.dataset = 'V0' AND v.c = 0 AND v.t = 0 AND v.z = w.z AND v.y = w.y AND v.x = w.x"""))
def prj7_feature_sampling(spark, d):
    at = A.nodes(spark, d).select("node_id", *(X.nearest_voxel(F.col(a) / 10, n).alias(a) for a, n in (("z", 6), ("y", 8), ("x", 8))))
    return at.join(A.volume(spark, d).filter("dataset = 'V0' AND c = 0 AND t = 0"), ["z", "y", "x"]).select("node_id", "value")


@query(with_tables("v", "SELECT dataset, c, t, z, y, x, CASE WHEN value > 50 THEN 1.0 ELSE 0.25 END AS w FROM v"))
def prj9_unlabelled_weight(spark, d):
    return A.volume(spark, d).select("dataset", "c", "t", "z", "y", "x", X.unlabelled_weight(F.col("value"), 50.0, 0.25).cast("double").alias("w"))




@query("SELECT doc_id, split_part(source || '_' || doc_id || '.zarr', '_', 1) AS prefix, regexp_replace(source || '_' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.zarr' ELSE '.geff' END, '\\.(zarr|geff)$', '') AS stem FROM documents")
def prj10_stems(spark, d):
    docs = A.read(spark, d, "documents")
    stem = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"))
    full = F.concat(stem, F.when(F.col("doc_id") % 2 == 0, ".zarr").otherwise(".geff"))
    return docs.select("doc_id", X.prefix(full).alias("prefix"), X.clean_stem(full).alias("stem"))


@query(with_tables("se", "SELECT source, target, round(exp(probability - max(probability) OVER w) / sum(exp(probability)) OVER w * exp(max(probability) OVER w), 6) AS p FROM se WINDOW w AS (PARTITION BY target)"))
def prj13_softmax(spark, d):
    return X.softmax(A.scored_pairs(A.nodes(spark, d)), "probability", ["dataset", "target"], "p").select("source", "target", R6("p").alias("p"))


@query(with_tables("e", "SELECT node_id, CASE WHEN k % 2 = 0 THEN k + 1 ELSE k END AS k FROM (SELECT node_id, greatest(1, CAST(round_even((node_id % 40) / 4.0 / 0.40625, 0) AS INTEGER)) AS k FROM e)"))
def prj15_odd_kernel(spark, d):
    return A.nodes(spark, d).select("node_id", X.odd_kernel((F.col("node_id") % 40) / 4.0, 0.40625).alias("k"))


def _two_logits(spark, d):
    se = A.scored_pairs(A.nodes(spark, d))
    return se.withColumn("f", F.col("probability") * 4 - 2).withColumn("b", ((F.col("source") * 7 + F.col("target") * 13) % 89) / 89.0 * 6 - 1)


_LOGITS = "l AS (SELECT source, target, probability * 4 - 2 AS f, ((source * 7 + target * 13) % 89) / 89.0 * 6 - 1 AS b FROM se)"
_ALIGN = "({v} - avg({v}) OVER w) * greatest(0.5, least(2.0, greatest(stddev_pop({l}) OVER w, 1e-4) / greatest(stddev_pop({v}) OVER w, 1e-4))) + avg({l}) OVER w"


@query(with_tables("se", _LOGITS + ", a AS (SELECT *, " + _ALIGN.format(v="b", l="f") + """ AS ab FROM l WINDOW w AS (PARTITION BY target)),
  s AS (SELECT *, greatest(exp(f) / sum(exp(f)) OVER w, 2.220446049250313e-16) AS pf, greatest(exp(ab) / sum(exp(ab)) OVER w, 2.220446049250313e-16) AS pb FROM a WINDOW w AS (PARTITION BY target)),
  h AS (SELECT *, 1 / (0.85 / pf + 0.15 / pb) AS h FROM s), n AS (SELECT *, ln(greatest(h / sum(h) OVER (PARTITION BY target), 2.220446049250313e-16)) AS ll FROM h)
  SELECT source, target, round(""" + _ALIGN.format(v="ll", l="f") + ", 5) AS logit FROM n WINDOW w AS (PARTITION BY target)"))
def prj16_bidirectional_logits(spark, d):
    df = X.bidirectional_logits(_two_logits(spark, d), "f", "b", ["dataset", "target"], "logit")
    return df.select("source", "target", F.round("logit", 5).alias("logit"))


def _blend_sql(expr: str) -> str:
    return with_tables("se", _LOGITS + ", a AS (SELECT *, " + _ALIGN.format(v="b", l="f") + """ AS c FROM l WINDOW w AS (PARTITION BY target)),
  r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY f DESC, source) AS rf, row_number() OVER (PARTITION BY target ORDER BY c DESC, source) AS rc FROM a),
  m AS (SELECT *, max(CASE WHEN rf = 1 THEN f END) OVER w AS f1, coalesce(max(CASE WHEN rf = 2 THEN f END) OVER w, max(CASE WHEN rf = 1 THEN f END) OVER w) AS f2, max(CASE WHEN rf = 1 THEN source END) OVER w AS sf,
    max(CASE WHEN rc = 1 THEN c END) OVER w AS c1, coalesce(max(CASE WHEN rc = 2 THEN c END) OVER w, max(CASE WHEN rc = 1 THEN c END) OVER w) AS c2, max(CASE WHEN rc = 1 THEN source END) OVER w AS sc FROM r WINDOW w AS (PARTITION BY target)),
  u AS (SELECT *, """ + expr + " AS use FROM m) SELECT source, target, round((1 - use) * f + use * c, 6) AS logit FROM u")


@query(_blend_sql("0.5"))
def prj17_blend_calibrated(spark, d):
    return X.blend_logits(_two_logits(spark, d), "f", "b", ["dataset", "target"], "source", "calibrated", "logit").select("source", "target", R6("logit").alias("logit"))


@query(_blend_sql("greatest(0.15, least(0.75, CASE WHEN (f1 - f2) + (c1 - c2) > 0 THEN (c1 - c2) / ((f1 - f2) + (c1 - c2)) ELSE 0.5 END))"))
def prj17_blend_adaptive(spark, d):
    return X.blend_logits(_two_logits(spark, d), "f", "b", ["dataset", "target"], "source", "adaptive", "logit").select("source", "target", R6("logit").alias("logit"))


@query(_blend_sql("CASE WHEN sf = sc THEN 0.5 * greatest(0.0, (1.0 - (f1 - f2)) / 1.0) ELSE 0.0 END"))
def prj17_blend_consensus(spark, d):
    return X.blend_logits(_two_logits(spark, d), "f", "b", ["dataset", "target"], "source", "low_margin_consensus", "logit").select("source", "target", R6("logit").alias("logit"))


@query(with_tables("e", "SELECT node_id FROM (SELECT node_id, CASE WHEN node_id % 31 = 0 THEN -10000.0 ELSE z END AS z, CASE WHEN node_id % 37 = 0 THEN -1000 ELSE t END AS t FROM e) WHERE NOT (z <= -9000 OR t <= -900)"))
def flt2_plausible(spark, d):
    k = F.col("node_id")
    n = A.nodes(spark, d).select("node_id", F.when(k % 31 == 0, -10000.0).otherwise(F.col("z")).alias("z"), F.when(k % 37 == 0, -1000).otherwise(F.col("t")).alias("t"))
    return n.filter(~X.implausible(F.col("z"), F.col("t"))).select("node_id")

"""Queries on splits, gates and comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import evaluation as E
from cladeframe.plans.registry import query
from cladeframe.sources import adapters as A
from cladeframe.sources import manifests as X
from cladeframe.sources.adapters import with_tables

METRICS = ["score", "adjusted_edge_jaccard", "division_jaccard"]
DIV = "CASE WHEN division_tp + division_fp + division_fn = 0 THEN 1.0 ELSE division_tp / (division_tp + division_fp + division_fn) END"

#: Metric rows by label: counts from fixed arithmetic on the label's nodes; ``k`` makes variants.
METRIC_SQL = """SELECT 'd' || label AS dataset, CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS fold, tp AS edge_tp, fp AS edge_fp, fn AS edge_fn, dtp AS division_tp, dfp AS division_fp, dfn AS division_fn,
    greatest(0, tp / (tp + fp + fn) * (1 - 0.1 * (ratio - 1))) AS adjusted_edge_jaccard, CASE WHEN dtp + dfp + dfn = 0 THEN 1.0 ELSE dtp / (dtp + dfp + dfn) END AS division_jaccard,
    greatest(0, tp / (tp + fp + fn) * (1 - 0.1 * (ratio - 1))) + 0.1 * CASE WHEN dtp + dfp + dfn = 0 THEN 1.0 ELSE dtp / (dtp + dfp + dfn) END AS score,
    recall AS node_recall, ratio AS node_count_ratio, fn AS edges_fragmented, (label * {0}) % 4 AS edges_lost_to_detection, fp AS wrong_association_edges
  FROM (SELECT label, count(*) + 10 AS tp, (label * {0}) % 7 AS fp, (label + {0}) % 5 AS fn, label % 3 AS dtp, (label + {0}) % 2 AS dfp, (label * {0}) % 2 AS dfn, 1 + ((label * {0}) % 9 - 4) / 50.0 AS ratio, 0.9 + ((label + {0}) % 8) / 100.0 AS recall FROM embeddings GROUP BY label)"""
TWO = f"WITH a AS ({METRIC_SQL.format(3)}), b AS ({METRIC_SQL.format(4)})"


def metric_rows(spark, d, k: int):
    lab = F.col("label").cast("bigint")
    g = A.read(spark, d, "embeddings").groupBy("label").agg((F.count(F.lit(1)) + 10).alias("edge_tp")).select(
        F.concat(F.lit("d"), F.col("label").cast("string")).alias("dataset"), F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("fold"), "edge_tp",
        ((lab * k) % 7).alias("edge_fp"), ((lab + k) % 5).alias("edge_fn"), (lab % 3).alias("division_tp"), ((lab + k) % 2).alias("division_fp"), ((lab * k) % 2).alias("division_fn"),
        (1 + ((lab * k) % 9 - 4) / 50.0).alias("node_count_ratio"), (0.9 + ((lab + k) % 8) / 100.0).alias("node_recall"), ((lab * k) % 4).alias("edges_lost_to_detection"),
    )
    j = F.col("edge_tp") / (F.col("edge_tp") + F.col("edge_fp") + F.col("edge_fn"))
    total = F.col("division_tp") + F.col("division_fp") + F.col("division_fn")
    g = g.withColumn("adjusted_edge_jaccard", F.greatest(F.lit(0.0), j * (1 - 0.1 * (F.col("node_count_ratio") - 1))))
    g = g.withColumn("division_jaccard", F.when(total == 0, 1.0).otherwise(F.col("division_tp") / total))
    return g.withColumn("score", F.col("adjusted_edge_jaccard") + 0.1 * F.col("division_jaccard")).withColumn("edges_fragmented", F.col("edge_fn")).withColumn("wrong_association_edges", F.col("edge_fp"))


@query(TWO + " SELECT a.dataset, round(b.score - a.score, 6) AS score_delta, round(b.adjusted_edge_jaccard - a.adjusted_edge_jaccard, 6) AS adjusted_edge_jaccard_delta FROM a JOIN b ON a.dataset = b.dataset")
def jn7_paired_rows(spark, d):
    df = E.paired(metric_rows(spark, d, 3), metric_rows(spark, d, 4), METRICS)
    return df.select("dataset", F.round("score_delta", 6).alias("score_delta"), F.round("adjusted_edge_jaccard_delta", 6).alias("adjusted_edge_jaccard_delta"))


@query(TWO + """, p AS (SELECT b.score - a.score AS s, b.adjusted_edge_jaccard - a.adjusted_edge_jaccard AS e, b.division_jaccard - a.division_jaccard AS v FROM a JOIN b ON a.dataset = b.dataset)
  SELECT count(*) AS num_datasets, count(*) FILTER (WHERE s > 0) AS score_wins, count(*) FILTER (WHERE s = 0) AS score_ties, count(*) FILTER (WHERE s < 0) AS score_losses,
    round(avg(s), 6) AS mean_score_delta, round(avg(e), 6) AS mean_adjusted_edge_jaccard_delta, round(avg(v), 6) AS mean_division_jaccard_delta FROM p""")
def ag15_win_tie_loss(spark, d):
    df = E.paired_summary(E.paired(metric_rows(spark, d, 3), metric_rows(spark, d, 4), METRICS), METRICS)
    return df.select(*(F.round(c, 6).alias(c) if c.startswith("mean") else F.col(c).cast("bigint").alias(c) for c in df.columns))


POOL = """SELECT {0} round(sum(adjusted_edge_jaccard * (edge_tp + edge_fp + edge_fn)) / sum(edge_tp + edge_fp + edge_fn) + 0.1 * sum(division_tp) / sum(division_tp + division_fp + division_fn), 6) AS score,
  round(sum(adjusted_edge_jaccard * (edge_tp + edge_fp + edge_fn)) / sum(edge_tp + edge_fp + edge_fn), 6) AS adjusted_edge_jaccard, round(sum(division_tp) / sum(division_tp + division_fp + division_fn), 6) AS division_jaccard,
  round(avg(node_recall), 6) AS node_recall_macro, round(avg(node_count_ratio), 6) AS node_count_ratio_macro FROM a {1}"""


@query(TWO + " " + POOL.format("fold,", "GROUP BY fold"))
def ag14_pooled_by_fold(spark, d):
    df = E.pooled(metric_rows(spark, d, 3), ["fold"])
    return df.select("fold", *(F.round(c, 6).alias(c) for c in df.columns[1:]))


BROKEN = """broken AS (SELECT dataset, edge_tp, CASE WHEN dataset = 'd1' THEN -1 ELSE edge_fp END AS edge_fp, edge_fn, division_tp, division_fp, division_fn, CASE WHEN dataset = 'd4' THEN -0.5 ELSE node_count_ratio END AS node_count_ratio,
    CASE WHEN dataset = 'd2' THEN adjusted_edge_jaccard + 0.01 ELSE adjusted_edge_jaccard END AS adjusted_edge_jaccard, CASE WHEN dataset = 'd3' THEN 'NaN'::DOUBLE WHEN dataset = 'd5' THEN score + 1 ELSE score END AS score FROM a
    UNION ALL SELECT dataset, edge_tp, edge_fp, edge_fn, division_tp, division_fp, division_fn, node_count_ratio, adjusted_edge_jaccard, score FROM a WHERE dataset = 'd6')"""


@query(TWO + ", " + BROKEN + """ , w AS (SELECT *, CASE WHEN edge_tp + edge_fp + edge_fn = 0 THEN 1.0 ELSE edge_tp / (edge_tp + edge_fp + edge_fn) END AS j, """ + DIV + """ AS dj FROM broken)
  SELECT dataset, 'not_finite' AS rule FROM w WHERE isnan(score) UNION ALL SELECT dataset, 'negative_count' FROM w WHERE edge_fp < 0 UNION ALL SELECT dataset, 'ratio_not_positive' FROM w WHERE node_count_ratio <= 0
  UNION ALL SELECT dataset, 'adjusted_mismatch' FROM w WHERE abs(adjusted_edge_jaccard - greatest(0, j * (1 - 0.1 * (node_count_ratio - 1)))) > 1e-9
  UNION ALL SELECT dataset, 'score_mismatch' FROM w WHERE abs(score - (adjusted_edge_jaccard + 0.1 * dj)) > 1e-9
  UNION ALL SELECT dataset, 'duplicate' FROM w GROUP BY dataset HAVING count(*) > 1""")
def vl3_integrity(spark, d):
    a = metric_rows(spark, d, 3)
    at = lambda x: F.col("dataset") == x
    bad = a.withColumn("edge_fp", F.when(at("d1"), -1).otherwise(F.col("edge_fp"))).withColumn("node_count_ratio", F.when(at("d4"), -0.5).otherwise(F.col("node_count_ratio")))
    bad = bad.withColumn("adjusted_edge_jaccard", F.when(at("d2"), F.col("adjusted_edge_jaccard") + 0.01).otherwise(F.col("adjusted_edge_jaccard")))
    bad = bad.withColumn("score", F.when(at("d3"), float("nan")).when(at("d5"), F.col("score") + 1).otherwise(F.col("score")))
    return E.integrity(bad.unionByName(a.filter(at("d6"))))


def _worse(scope: str, name: str, rows: str, recall: str, ratio: str) -> str:
    """Rows (scope, name, metric) of what is worse in the pairs ``rows`` of p_ and c_ columns."""
    tests = {m: f"c_{m} < p_{m} - 1e-9" for m in ("adjusted_edge_jaccard", "division_jaccard", recall)}
    tests["node_count_ratio"] = f"abs(c_{ratio} - 1) > abs(p_{ratio} - 1) + 1e-9"
    tests |= {m: f"c_{m} > p_{m} + 1e-9" for m in ("edges_fragmented", "edges_lost_to_detection", "wrong_association_edges")}
    return " UNION ALL ".join(f"SELECT '{scope}' AS scope, {name} AS name, '{m}' AS metric FROM {rows} WHERE {t}" for m, t in tests.items())


def _sums(table: str, side: str, by: str) -> str:
    tp, fp, fn = (f"sum(division_{x})" for x in ("tp", "fp", "fn"))
    macro = f"sum(adjusted_edge_jaccard * (edge_tp + edge_fp + edge_fn)) / sum(edge_tp + edge_fp + edge_fn) AS {side}_adjusted_edge_jaccard, CASE WHEN {tp} + {fp} + {fn} = 0 THEN 1.0 ELSE {tp} / ({tp} + {fp} + {fn}) END AS {side}_division_jaccard"
    means = f"avg(node_recall) AS {side}_node_recall_macro, avg(node_count_ratio) AS {side}_node_count_ratio_macro"
    counts = ", ".join(f"sum({m}) AS {side}_{m}" for m in ("edges_fragmented", "edges_lost_to_detection", "wrong_association_edges"))
    return f"(SELECT {by + ', ' if by else ''}{macro}, {means}, {counts} FROM {table}{' GROUP BY ' + by if by else ''})"


def _sided(table: str, side: str) -> str:
    names = ("adjusted_edge_jaccard", "division_jaccard", "node_recall", "node_count_ratio", "edges_fragmented", "edges_lost_to_detection", "wrong_association_edges")
    return f"(SELECT fold, dataset, {', '.join(f'{m} AS {side}_{m}' for m in names)} FROM {table})"


REVIEW = f"""{TWO}, r1 AS (SELECT * FROM {_sided('a', 'p')} JOIN {_sided('b', 'c')} USING (fold, dataset)), r2 AS (SELECT * FROM {_sums('a', 'p', 'fold')} JOIN {_sums('b', 'c', 'fold')} USING (fold)),
  r3 AS (SELECT * FROM {_sums('a', 'p', '')} p, {_sums('b', 'c', '')} c)
  {_worse('dataset', 'dataset', 'r1', 'node_recall', 'node_count_ratio')} UNION ALL {_worse('fold', 'fold', 'r2', 'node_recall_macro', 'node_count_ratio_macro')} UNION ALL {_worse('pooled', "'all'", 'r3', 'node_recall_macro', 'node_count_ratio_macro')}"""


@query(REVIEW)
def ag25_review(spark, d):
    return E.review(metric_rows(spark, d, 3), metric_rows(spark, d, 4))


SCORE = "SELECT {0} sum(adjusted_edge_jaccard * (edge_tp + edge_fp + edge_fn)) / sum(edge_tp + edge_fp + edge_fn) + 0.1 * sum(division_tp) / sum(division_tp + division_fp + division_fn) AS s FROM {1} {2}"


@query(TWO + ", pa AS (" + SCORE.format("", "a", "") + "), pb AS (" + SCORE.format("", "b", "") + "), fa AS (" + SCORE.format("fold,", "a", "GROUP BY fold") + "), fb AS (" + SCORE.format("fold,", "b", "GROUP BY fold") + """)
  , r AS (SELECT 'pooled' AS scope, 'all' AS name, pb.s - pa.s AS delta, pb.s - pa.s >= 0.001 AS passed FROM pa, pb UNION ALL SELECT 'fold', fold, fb.s - fa.s, fb.s - fa.s >= -0.003 FROM fa JOIN fb USING (fold)
  UNION ALL SELECT 'dataset', a.dataset, b.score - a.score, b.score - a.score >= -0.003 FROM a JOIN b ON a.dataset = b.dataset) SELECT scope, name, round(delta, 6) AS delta, passed, FALSE AS promote FROM r""")
def vl5_promotion(spark, d):
    df = E.promotion(metric_rows(spark, d, 3), metric_rows(spark, d, 4))
    return df.withColumn("delta", F.round("delta", 6))


@query(with_tables("cs", "SELECT epoch, checkpoint, CAST(count(*) AS BIGINT) AS n_folds, round(avg(score), 6) AS mean_score, round(max(score) FILTER (WHERE fold = 'fold_0'), 6) AS fold_0 FROM cs GROUP BY 1, 2"))
def src10_checkpoint_scores(spark, d):
    df = E.by_checkpoint(A.checkpoint_scores(spark, d))
    return df.select("epoch", "checkpoint", "n_folds", F.round("mean_score", 6).alias("mean_score"), F.round(F.try_element_at("folds", F.lit("fold_0")), 6).alias("fold_0"))


@query(with_tables("cs", "SELECT epoch, checkpoint, round(avg(score), 6) AS mean_score FROM cs GROUP BY 1, 2 ORDER BY avg(score) DESC, epoch, checkpoint LIMIT 1"))
def rk10_best_checkpoint(spark, d):
    return E.best_checkpoint(A.checkpoint_scores(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query(with_tables("cs", """b AS (SELECT fold, score AS base FROM cs WHERE epoch = 2 AND checkpoint = (SELECT min(checkpoint) FROM cs)),
  r AS (SELECT epoch, checkpoint, avg(score) - avg(base) AS gain, min(score - base) AS worst, avg(score) AS mean FROM cs JOIN b USING (fold) WHERE epoch > 2 GROUP BY 1, 2)
  SELECT epoch, checkpoint, round(gain, 6) AS gain, round(worst, 6) AS worst, gain >= 0.003 AND worst >= -0.001 AS passed,
    CASE WHEN gain >= 0.003 AND worst >= -0.001 THEN 'passed' WHEN gain < 0.003 THEN 'gain too small' ELSE 'a fold regressed' END AS reason FROM r ORDER BY passed DESC, mean DESC, epoch, checkpoint LIMIT 1"""))
def rk12_learning_gate(spark, d):
    cs = A.checkpoint_scores(spark, d)
    name = cs.agg(F.min("checkpoint")).first()[0]
    df = E.learning_gate(cs, 2, name)
    return df.withColumn("gain", F.round("gain", 6)).withColumn("worst", F.round("worst", 6))


@query(with_tables("cs", """p AS (SELECT a.checkpoint AS p, b.checkpoint AS q, a.score AS x, b.score AS y FROM cs a JOIN cs b ON a.epoch = b.epoch AND a.fold = b.fold AND a.checkpoint < b.checkpoint)
  SELECT p, q, round(corr(x, y), 6) AS correlation FROM p GROUP BY 1, 2"""))
def ag20_correlation(spark, d):
    cs = A.checkpoint_scores(spark, d)
    a, b = cs.alias("a"), cs.alias("b")
    pairs = a.join(b, (F.col("a.epoch") == F.col("b.epoch")) & (F.col("a.fold") == F.col("b.fold")) & (F.col("a.checkpoint") < F.col("b.checkpoint"))).select(
        F.col("a.checkpoint").alias("p"), F.col("b.checkpoint").alias("q"), F.col("a.score").alias("x"), F.col("b.score").alias("y"))
    return E.correlation(pairs, "x", "y", ["p", "q"]).withColumn("correlation", F.round("correlation", 6))


@query(with_tables("cs", """able AS (SELECT checkpoint, avg(score) AS mean FROM cs GROUP BY 1),
  whole AS (SELECT epoch, fold FROM cs GROUP BY 1, 2 HAVING count(DISTINCT checkpoint) = (SELECT count(DISTINCT checkpoint) FROM cs)), held AS (SELECT cs.* FROM cs JOIN whole USING (epoch, fold)),
  co AS (SELECT a.checkpoint AS p, b.checkpoint AS q, corr(1 - a.score, 1 - b.score) AS r FROM held a JOIN held b ON a.epoch = b.epoch AND a.fold = b.fold AND a.checkpoint <> b.checkpoint GROUP BY 1, 2),
  f AS (SELECT checkpoint FROM able ORDER BY mean DESC, checkpoint LIMIT 1), g AS (SELECT p AS checkpoint FROM co JOIN f ON q = f.checkpoint JOIN able ON able.checkpoint = p ORDER BY r, mean DESC, p LIMIT 1),
  h AS (SELECT p AS checkpoint FROM co JOIN able ON able.checkpoint = p WHERE q IN (SELECT checkpoint FROM f UNION ALL SELECT checkpoint FROM g) AND p NOT IN (SELECT checkpoint FROM f UNION ALL SELECT checkpoint FROM g) GROUP BY p, mean ORDER BY sum(r), mean DESC, p LIMIT 1)
  SELECT 1 AS rank, checkpoint FROM f UNION ALL SELECT 2, checkpoint FROM g UNION ALL SELECT 3, checkpoint FROM h"""))
def rk11_complementary(spark, d):
    cs = A.checkpoint_scores(spark, d)
    errors = cs.select("checkpoint", F.concat_ws("/", F.col("epoch").cast("string"), "fold").alias("sample"), (1 - F.col("score")).alias("error"))
    n = cs.agg(F.countDistinct("checkpoint")).first()[0]  # a few names
    whole = errors.groupBy("sample").agg(F.countDistinct("checkpoint").alias("k")).filter(F.col("k") == n).select("sample")
    errors = errors.join(whole, "sample", "left_semi")  # samples that every checkpoint has
    return E.complementary(cs.select("checkpoint", F.lit(0).alias("epoch"), "score"), errors, max_drop=1.0)


@query(with_tables("cs", """r AS (SELECT checkpoint AS run, epoch, round(avg(score), 6) AS score FROM cs GROUP BY 1, 2),
  b AS (SELECT *, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past, max(score) OVER (PARTITION BY run ORDER BY epoch) AS best FROM r),
  g AS (SELECT *, past IS NULL OR score > past AS is_best, sum((past IS NULL OR score > past)::INT) OVER (PARTITION BY run ORDER BY epoch) AS k FROM b),
  s AS (SELECT *, row_number() OVER (PARTITION BY run, k ORDER BY epoch) - 1 AS since_best FROM g) SELECT run, epoch, score, best, is_best, since_best, since_best >= 3 AS stop FROM s"""))
def vl7_early_stop(spark, d):
    rows = A.checkpoint_scores(spark, d).groupBy(F.col("checkpoint").alias("run"), "epoch").agg(F.round(F.avg("score"), 6).alias("score"))
    return E.early_stop(rows, 3)


@query("""WITH s AS (SELECT DISTINCT source || '_' || lang AS dataset, source AS prefix FROM documents WHERE lang <> 'es' OR source <> 'src0'), r AS (SELECT prefix, row_number() OVER (ORDER BY prefix) AS k FROM (SELECT DISTINCT prefix FROM s))
  SELECT f.fold, s.dataset, CASE WHEN r.k = f.k THEN 'evaluate' ELSE 'train' END AS role FROM s JOIN r USING (prefix), (SELECT 'A' AS fold, 1 AS k UNION ALL SELECT 'B', 2) f""")
def vl1_holdout_plan(spark, d):
    docs = A.read(spark, d, "documents").select(F.concat_ws("_", "source", "lang").alias("dataset")).distinct()
    return E.holdout_plan(docs, docs.filter("dataset = 'src0_es'"))


@query()
def vl2_group_split(spark, d):
    rows = E.group_split(A.read(spark, d, "documents").select("doc_id", "source"), "source", {"train": 0.7, "valid": 0.1, "calibrate": 0.1, "test": 0.1})
    return rows.groupBy("part").agg(F.countDistinct("source").alias("groups"), F.count(F.lit(1)).alias("rows"))


@query(with_tables("e", """th AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS threshold), s AS (SELECT node_id, (node_id * 7 % 100) / 100.0 AS score FROM e)
  SELECT threshold, round(count(*) FILTER (WHERE score >= threshold) / 200.0, 6) AS ratio, round(count(*) FILTER (WHERE score >= threshold AND node_id % 2 = 0) / count(*) FILTER (WHERE node_id % 2 = 0), 6) AS recall FROM s, th GROUP BY 1
  ORDER BY abs(ln(count(*) FILTER (WHERE score >= threshold) / 200.0)), 3 DESC, 1 DESC LIMIT 1"""))
def ag22_threshold_choice(spark, d):
    n = A.nodes(spark, d).select("node_id", ((F.col("node_id") * 7 % 100) / 100.0).alias("score"))
    each = n.withColumn("threshold", F.explode(F.array(*(F.lit(x) for x in (0.1, 0.3, 0.5, 0.7, 0.9)))))
    up, even = F.col("score") >= F.col("threshold"), F.col("node_id") % 2 == 0
    rows = each.groupBy("threshold").agg((F.sum(up.cast("int")) / 200.0).alias("ratio"), (F.sum((up & even).cast("int")) / F.sum(even.cast("int"))).alias("recall"))
    return E.threshold_choice(rows).select("threshold", F.round("ratio", 6).alias("ratio"), F.round("recall", 6).alias("recall"))


@query(with_tables("cs", "SELECT fold || '/' || epoch AS sample, " + ", ".join(f"round(max(1 - score) FILTER (WHERE checkpoint = '{c}'), 8) AS \"{c}\"" for c in ("click", "error", "purchase", "signup", "view")) + " FROM cs GROUP BY 1"))
def ag24_error_pivot(spark, d):
    names = ["click", "error", "purchase", "signup", "view"]
    cs = A.checkpoint_scores(spark, d).select(F.concat_ws("/", "fold", F.col("epoch").cast("string")).alias("sample"), "checkpoint", F.round(1 - F.col("score"), 8).alias("error"))
    return cs.groupBy("sample").pivot("checkpoint", names).agg(F.max("error"))


@query(with_tables("u", """m AS (SELECT count(*) AS n, avg(ln(1 + y)) AS my, avg(z) AS mz, avg(x) AS mx, stddev_pop(z) AS sz, stddev_pop(x) AS sx, covar_pop(z, x) AS zx, covar_pop(z, ln(1 + y)) AS zy, covar_pop(x, ln(1 + y)) AS xy FROM u),
  g AS (SELECT *, n + 1.0 AS a, n * zx / (sz * sx) AS b, n * zy / sz AS p, n * xy / sx AS q FROM m), w AS (SELECT *, (p * a - b * q) / (a * a - b * b) AS wz, (a * q - b * p) / (a * a - b * b) AS wx FROM g)
  SELECT node_id, round(greatest(0, exp(my + (z - mz) / sz * wz + (x - mx) / sx * wx) - 1), 6) AS predicted FROM u, w"""))
def ag18_ridge(spark, d):
    rows = A.user_days(spark, d)
    model = E.fit_ridge(rows, ["z", "x"], "y")
    return rows.select("node_id", F.round(E.predict_ridge(model), 6).alias("predicted"))


@query()
def ag19_fit_temperature(spark, d):
    se = A.scored_edges(A.nodes(spark, d)).select("probability", (((F.col("source") + F.col("target")) % 3) == 0).cast("int").alias("label"))
    return spark.createDataFrame([(round(E.fit_temperature(se, "probability", "label"), 4),)], "temperature double")


@query(with_tables("cs", """m AS (SELECT checkpoint, avg(score) AS s FROM cs GROUP BY 1), b AS (SELECT checkpoint, s FROM m ORDER BY s DESC, checkpoint LIMIT 1), f AS (SELECT checkpoint, s FROM m ORDER BY checkpoint LIMIT 1)
  SELECT CASE WHEN b.s > f.s + 0.0005 THEN b.checkpoint ELSE f.checkpoint END AS setting FROM b, f"""))
def rk13_sweep(spark, d):
    rows = A.checkpoint_scores(spark, d).groupBy(F.col("checkpoint").alias("setting")).agg(F.avg("score").alias("score"))
    return E.sweep_best(rows, F.min("setting"))


@query(TWO + " SELECT count(*) AS n_datasets, " + POOL.format("", "").removeprefix("SELECT ").replace(", round(avg(node_recall), 6) AS node_recall_macro", "").replace(",\n  round(avg(node_recall), 6) AS node_recall_macro, round(avg(node_count_ratio), 6) AS node_count_ratio_macro", ""))
def ag10_aggregate_rows(spark, d):
    from cladeframe.operators.metrics import aggregate

    df = aggregate(metric_rows(spark, d, 3))
    return df.select("n_datasets", *(F.round(c, 6).alias(c) for c in ("score", "adjusted_edge_jaccard", "division_jaccard")))


@query(TWO + """ SELECT CAST(sum(edge_tp) AS BIGINT) AS edge_tp, CAST(sum(edges_fragmented) AS BIGINT) AS edges_fragmented, CAST(sum(edges_lost_to_detection) AS BIGINT) AS edges_lost_to_detection,
  CAST(sum(wrong_association_edges) AS BIGINT) AS wrong_association_edges,
  round(sum(edge_tp) / nullif(sum(edge_tp + edge_fp + edge_fn), 0) + 0.1 * coalesce(sum(division_tp) / nullif(sum(division_tp + division_fp + division_fn), 0), 0), 6) AS proxy FROM a""")
def ag21_error_sums(spark, d):
    """Summed errors and the proxy score, where an empty denominator counts as 0."""
    from cladeframe.functions.scalar import jaccard

    s = metric_rows(spark, d, 3).agg(*(F.sum(c).alias(c) for c in ("edge_tp", "edge_fp", "edge_fn", "division_tp", "division_fp", "division_fn", "edges_fragmented", "edges_lost_to_detection", "wrong_association_edges")))
    proxy = jaccard(F.col("edge_tp"), F.col("edge_fp"), F.col("edge_fn"), 0.0) + 0.1 * jaccard(F.col("division_tp"), F.col("division_fp"), F.col("division_fn"), 0.0)
    return s.select("edge_tp", "edges_fragmented", "edges_lost_to_detection", "wrong_association_edges", F.round(proxy, 6).alias("proxy"))


@query("SELECT n, unnest(list_distinct(list_concat(range(0, greatest(n - 16, 0) + 1, 15), [greatest(n - 16, 0)]))) AS start FROM (SELECT DISTINCT 20 + n_nationkey * 3 AS n FROM nation)")
def wn7_inference_windows(spark, d):
    """Windows of 16 frames every 15, the last one moved back to the end."""
    n = A.read(spark, d, "nation").select((20 + F.col("n_nationkey") * 3).cast("bigint").alias("n")).distinct()
    last = F.greatest(F.col("n") - 16, F.lit(0))
    return n.select("n", F.explode(F.array_union(F.sequence(F.lit(0).cast("bigint"), last, F.lit(15).cast("bigint")), F.array(last))).alias("start"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS run, source || '/' || doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'mismatch' END AS problem FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0""")
def vl4_evidence(spark, d):
    """Claimed digests of texts against the actual ones, some of them absent or wrong."""
    from cladeframe.sources.manifests import evidence

    docs = A.read(spark, d, "documents").select(F.col("doc_id").cast("string").alias("run"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))
    claims = docs.withColumn("sha256", F.when(F.col("doc_id") % 7 == 0, F.sha2(F.lit("other"), 256)).otherwise(F.col("sha256")))
    return evidence(claims.select("run", "path", "sha256"), docs.filter("doc_id % 5 <> 0").select("path", "sha256"))


@query(with_tables("e", "SELECT unnest(['E', 'none', 'other']) AS dataset, unnest([(SELECT count(*) FROM e), 0, 0]) AS n"))
def vl8_empty_start(spark, d):
    return E.empty_start(A.nodes(spark, d), ["E", "none", "other", "later"])


@query("""WITH r AS (SELECT 'run-' || doc_id AS candidate, 'text/' || doc_id AS config_path, 'text/' || (doc_id + 1) AS split_path FROM labels WHERE doc_id IS NOT NULL AND doc_id IN (SELECT doc_id FROM documents) AND doc_id + 1 IN (SELECT doc_id FROM documents)),
  n AS (SELECT 'text/' || doc_id AS path, doc_id % 5 = 0 AS changed, doc_id % 35 = 7 AS gone FROM documents)
  SELECT DISTINCT candidate, CASE WHEN gone THEN what || ' missing' ELSE what || ' hash' END AS problem FROM (SELECT candidate, 'config' AS what, changed, gone FROM r JOIN n ON path = config_path UNION ALL SELECT candidate, 'split', changed, gone FROM r JOIN n ON path = split_path) WHERE changed OR gone""")
def vl6_run_manifests(spark, d):
    """Manifests of runs over two texts each, checked when some texts have changed and some are gone."""
    docs = A.read(spark, d, "documents").select(F.concat(F.lit("text/"), F.col("doc_id").cast("string")).alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    then = docs.select("path", F.sha2("text", 256).alias("sha256"))
    now = docs.filter("doc_id % 35 <> 7").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    run = lambda k: F.concat(F.lit("text/"), (F.col("doc_id") + k).cast("string"))
    runs = A.read(spark, d, "labels").filter("doc_id IS NOT NULL").select("doc_id").distinct().select(
        F.concat(F.lit("run-"), F.col("doc_id").cast("string")).alias("candidate"), run(0).alias("config_path"), run(1).alias("split_path"), F.lit("A").alias("fold"), F.lit(0).cast("bigint").alias("seed"),
        F.lit(9.0).alias("max_hours"), F.lit("unknown").alias("commit"), F.lit("2026-01-01T00:00:00+00:00").alias("created_at"))
    known = then.select("path")
    able = runs.join(known.withColumnRenamed("path", "config_path"), "config_path", "left_semi").join(known.withColumnRenamed("path", "split_path"), "split_path", "left_semi")
    return X.manifest_changes(X.manifests(able, then), now)

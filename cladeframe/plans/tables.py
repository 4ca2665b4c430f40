"""Queries on reading, checking and writing tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cladeframe.plans.registry import query
from cladeframe.scratch import shared_dir
from cladeframe.sources import adapters as A
from cladeframe.sources import chunked
from cladeframe.sources import submission as S
from cladeframe.sources import volumes
from cladeframe.sources.adapters import with_tables

SUB = """sub AS (SELECT dataset, 'node' AS row_type, node_id, CAST(t AS BIGINT) AS t, z, y, x, CAST(-1 AS BIGINT) AS source_id, CAST(-1 AS BIGINT) AS target_id FROM e
  UNION ALL SELECT dataset, 'edge', -1, -1, -1.0, -1.0, -1.0, source, target FROM gd)"""
BAD = """bad AS (SELECT dataset, CASE WHEN node_id % 97 = 5 THEN 'blob' ELSE row_type END AS row_type, node_id, t, CASE WHEN node_id % 89 = 7 THEN 'NaN'::DOUBLE ELSE z END AS z, y, x,
    CASE WHEN row_type = 'node' AND node_id % 83 = 11 THEN 4 ELSE source_id END AS source_id, CASE WHEN row_type = 'edge' AND target_id % 79 = 3 THEN target_id + 9000000 ELSE target_id END AS target_id,
    FROM sub UNION ALL SELECT * FROM sub WHERE row_type = 'node' AND node_id % 73 = 2 UNION ALL SELECT dataset, row_type, 7, t, z, y, x, source_id, target_id FROM sub WHERE row_type = 'edge' AND source_id % 71 = 0)"""


def _submission(spark, d):
    n = A.nodes(spark, d)
    return A.submission(n, A.forest_edges(n))


def _corrupt(spark, d):
    s = _submission(spark, d)
    node, k = F.col("row_type") == "node", F.col("node_id")
    bad = s.select(
        "dataset", F.when(k % 97 == 5, "blob").otherwise(F.col("row_type")).alias("row_type"), "node_id", "t", F.when(k % 89 == 7, float("nan")).otherwise(F.col("z")).alias("z"), "y", "x",
        F.when(node & (k % 83 == 11), 4).otherwise(F.col("source_id")).alias("source_id"),
        F.when(~node & (F.col("target_id") % 79 == 3), F.col("target_id") + 9000000).otherwise(F.col("target_id")).alias("target_id"),
    )
    return bad.unionByName(s.filter(node & (k % 73 == 2))).unionByName(s.filter(~node & (F.col("source_id") % 71 == 0)).withColumn("node_id", F.lit(7).cast("bigint")))


@query(with_tables("e gd", SUB + ", " + BAD + """, n AS (SELECT * FROM bad WHERE row_type = 'node'), be AS (SELECT * FROM bad WHERE row_type = 'edge')
  SELECT dataset, 'row_type' AS rule, row_type AS id FROM bad WHERE row_type NOT IN ('node', 'edge') UNION ALL SELECT dataset, 'duplicate_node', CAST(node_id AS VARCHAR) FROM n GROUP BY dataset, node_id HAVING count(*) > 1
  UNION ALL SELECT dataset, 'node_sentinel', CAST(node_id AS VARCHAR) FROM n WHERE source_id <> -1 OR target_id <> -1 UNION ALL SELECT dataset, 'edge_sentinel', CAST(source_id AS VARCHAR) FROM be WHERE node_id <> -1
  UNION ALL SELECT dataset, 'not_finite', CAST(node_id AS VARCHAR) FROM n WHERE isnan(z)
  UNION ALL SELECT dataset, 'dangling_edge', CAST(i AS VARCHAR) FROM (SELECT dataset, source_id AS i FROM be UNION SELECT dataset, target_id FROM be) WHERE i NOT IN (SELECT node_id FROM n)"""))
def src2_violations(spark, d):
    return S.violations(_corrupt(spark, d))


@query(with_tables("e gd", SUB + " SELECT dataset, row_type, count(*) AS n, round(sum(z), 4) AS z FROM sub GROUP BY 1, 2"))
def src3_lenient_parse(spark, d):
    n, e = S.to_graph(_submission(spark, d), strict=False)
    a = n.groupBy("dataset").agg(F.lit("node").alias("row_type"), F.count(F.lit(1)).alias("n"), F.round(F.sum("z"), 4).alias("z"))
    return a.unionByName(e.groupBy("dataset").agg(F.lit("edge").alias("row_type"), F.count(F.lit(1)).alias("n"), F.round(F.sum(F.lit(-1.0)), 4).alias("z")))


@query(with_tables("e gd", SUB + " SELECT dataset, row_type, node_id, t, round(z, 6) AS z, source_id, target_id FROM sub"))
def src1_submission_round_trip(spark, d):
    """Written as CSV in the shared folder, read again, parsed with all checks."""
    path = f"{shared_dir(spark)}/submission-{uuid.uuid4().hex}"
    S.write_csv(_submission(spark, d), path)
    n, e = S.to_graph(S.read_csv(spark, path))
    return A.submission(n, e).select("dataset", "row_type", "node_id", "t", F.round("z", 6).alias("z"), "source_id", "target_id")


@query(with_tables("v", "SELECT * FROM v WHERE t = 1 AND z BETWEEN 2 AND 4 AND y BETWEEN 3 AND 8 AND x < 6"))
def src6_patch(spark, d):
    return A.volume(spark, d).filter("t = 1 AND z BETWEEN 2 AND 4 AND y BETWEEN 3 AND 8 AND x < 6")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS dataset, CAST(round_even(n_nationkey * 2.5, 0) AS BIGINT) AS estimate FROM nation")
def src7_estimates(spark, d):
    return S.node_estimates(A.read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("volume"), (F.col("n_nationkey") * 2.5).alias("est")))


@query("""WITH p AS (SELECT n_name AS volume, CASE WHEN n_regionkey % 2 = 0 THEN 'evaluate' ELSE 'tune' END AS a, CASE WHEN n_regionkey % 2 = 1 THEN 'evaluate' ELSE 'tune' END AS b FROM nation WHERE n_nationkey % 6 <> 0)
  SELECT 'A' AS fold, volume AS dataset, CASE WHEN a = 'evaluate' THEN 'evaluate' ELSE 'train' END AS role FROM p UNION ALL SELECT 'B', volume, CASE WHEN b = 'evaluate' THEN 'evaluate' ELSE 'train' END FROM p""")
def src8_pack_folds(spark, d):
    r = F.col("n_regionkey") % 2
    return S.pack_folds(A.read(spark, d, "nation").select(
        F.col("n_name").alias("volume"), F.when(r == 0, "evaluate").otherwise("tune").alias("fold_A_role"), F.when(r == 1, "evaluate").otherwise("tune").alias("fold_b_role"),
        (F.col("n_nationkey") % 6 == 0).alias("is_public_test_twin")))


@query(with_tables("e gd", SUB + ", k AS (SELECT *, row_number() OVER (ORDER BY dataset, row_type = 'edge', t, CAST(node_id AS VARCHAR), CAST(source_id AS VARCHAR), CAST(target_id AS VARCHAR)) AS place FROM sub) SELECT place, dataset, row_type, node_id, t, source_id, target_id FROM k"))
def snk1_export_order(spark, d):
    rows = S.ordered(_submission(spark, d))
    from pyspark.sql import Window

    w = Window.partitionBy("dataset").orderBy(F.col("row_type") == "edge", "t", F.col("node_id").cast("string"), F.col("source_id").cast("string"), F.col("target_id").cast("string"))
    return rows.select(F.row_number().over(w).cast("bigint").alias("place"), "dataset", "row_type", "node_id", "t", "source_id", "target_id")


@query(with_tables("cs", """log AS (SELECT * FROM cs WHERE epoch < 10), fresh AS (SELECT epoch, checkpoint, fold, CASE WHEN epoch = 5 THEN score + 0.1 ELSE score END AS score FROM cs WHERE epoch BETWEEN 5 AND 14)
  SELECT * FROM log UNION ALL SELECT fresh.* FROM fresh LEFT JOIN log USING (epoch, checkpoint, fold) WHERE log.score IS NULL"""))
def snk4_idempotent_append(spark, d):
    cs = A.checkpoint_scores(spark, d)
    fresh = cs.filter("epoch BETWEEN 5 AND 14").withColumn("score", F.when(F.col("epoch") == 5, F.col("score") + 0.1).otherwise(F.col("score")))
    return S.appended(cs.filter("epoch < 10"), fresh, ["epoch", "checkpoint", "fold"], "score")[0]


@query(with_tables("cs", "SELECT epoch, checkpoint, fold, round(score + 0.1, 6) AS score FROM cs WHERE epoch = 5"))
def snk5_append_conflicts(spark, d):
    cs = A.checkpoint_scores(spark, d)
    fresh = cs.filter("epoch BETWEEN 5 AND 14").withColumn("score", F.when(F.col("epoch") == 5, F.col("score") + 0.1).otherwise(F.col("score") + 1e-13))
    return S.appended(cs.filter("epoch < 10"), fresh, ["epoch", "checkpoint", "fold"], "score", 1e-12)[1].select("epoch", "checkpoint", "fold", F.round("score", 6).alias("score"))


#: The same graph as three datasets, by ranges of ids; edges across them are left out.
PARTED = "CASE WHEN {0} % 1000 < 100 THEN 'A' WHEN {0} % 1000 < 300 THEN 'B' ELSE 'C' END"
THREE = SUB + ", st AS (SELECT CASE WHEN row_type = 'node' THEN " + PARTED.format("node_id") + " ELSE " + PARTED.format("source_id") + " END AS dataset, row_type, node_id, t, z, y, x, source_id, target_id FROM sub WHERE row_type = 'node' OR " + PARTED.format("source_id") + " = " + PARTED.format("target_id") + ")"


def _three(spark, d):
    name = lambda c: F.when(F.col(c) % 1000 < 100, "A").when(F.col(c) % 1000 < 300, "B").otherwise("C")
    s, node = _submission(spark, d), F.col("row_type") == "node"
    return s.filter(node | (name("source_id") == name("target_id"))).withColumn("dataset", F.when(node, name("node_id")).otherwise(name("source_id")))


@query(with_tables("e gd", THREE + """ SELECT row_number() OVER (ORDER BY dataset, row_type = 'edge', node_id, source_id, target_id) - 1 AS id, dataset, row_type, node_id, t,
  CAST(CASE WHEN row_type = 'node' THEN greatest(0, round_even(z, 0)) ELSE z END AS BIGINT) AS z, CAST(CASE WHEN row_type = 'node' THEN greatest(0, round_even(y, 0)) ELSE y END AS BIGINT) AS y,
  CAST(CASE WHEN row_type = 'node' THEN greatest(0, round_even(x, 0)) ELSE x END AS BIGINT) AS x, source_id, target_id FROM st"""))
def snk6_numbered_rows(spark, d):
    return S.numbered(_three(spark, d))


@query(with_tables("cs", """r AS (SELECT checkpoint, max(score) AS score FROM cs GROUP BY 1) SELECT checkpoint AS candidate, round(score, 6) AS score, 'prefix' AS split, '' AS notes, CAST(NULL AS DOUBLE) AS public_lb, '2026-01-01T00:00:00' AS created_at FROM r, range(2)"""))
def snk3_experiment_log(spark, d):
    """Two appends to one log."""
    rows = A.checkpoint_scores(spark, d).groupBy(F.col("checkpoint").alias("candidate")).agg(F.max("score").alias("score")).select(
        "candidate", "score", F.lit(0.5).alias("adjusted_edge_jaccard"), F.lit(0.1).alias("division_jaccard"), F.lit("prefix").alias("split"), F.lit("made").alias("split_provenance"),
        F.lit("own").alias("scorer_provenance"), F.lit("unknown").alias("commit_sha"), F.lit("2026-01-01T00:00:00").alias("created_at"))
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    S.append_log(rows, path)
    return S.append_log(rows, path).select("candidate", F.round("score", 6).alias("score"), "split", "notes", "public_lb", "created_at")


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def prj12_text_digests(spark, d):
    return A.read(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


@query(with_tables("v", "SELECT dataset, t, c, z, y, x, value FROM v WHERE c = 0 AND t BETWEEN 1 AND 2"))
def src5_chunked_volume(spark, d):
    """The volumes written as stores of chunks (so that chunks are cut off at the border), and two frames of one channel read back."""
    path = f"{shared_dir(spark)}/volumes-{uuid.uuid4().hex}"
    chunked.write_voxels(A.volume(spark, d), path, (1, 1, 4, 8, 8))
    return spark.read.format("chunked_arrays").option("missing", "skip").load(path).filter("c = 0 AND t BETWEEN 1 AND 2 AND NOT isnan(value)")


@query(with_tables("e gd", SUB + " SELECT * FROM sub"))
def src11_graph_store(spark, d):
    """The forest written as arrays of a graph store and read back."""
    path = f"{shared_dir(spark)}/graph-{uuid.uuid4().hex}"
    n = A.nodes(spark, d)
    volumes.write_graph(n, A.forest_edges(n), path, chunk=1 << 14)
    return A.submission(*volumes.read_graph(spark, path, "E"))

"""The jobs as registered queries, run twice over whole tables, with their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cladeframe.scratch import shared_dir
from jobs import reply_trees, track_ledger


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def job1_track_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "track-ledger")
    for _ in range(2):  # the second run finds nothing new; a stream takes folders or patterns, and the table may be one file
        track_ledger.update(spark, f"{sf_dir}/events.parquet*", out, f"{out}/checkpoint", track_ledger.DEFAULTS)
    return track_ledger.result(spark, out)


def job2_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "reply-trees")
    for _ in range(2):
        reply_trees.build(spark, f"{sf_dir}/conversations.parquet", out, reply_trees.DEFAULTS)
    return reply_trees.result(spark, out)


JOB1 = """
WITH n AS (
  SELECT user_id * 100000 + t AS node_id, t, CAST(sum(v) AS DOUBLE) / count(v) / 1e7 AS z, CAST(count(*) AS DOUBLE) AS y, max(v) / 1e7 AS x
  FROM (SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS t, CAST(round(value * 1e6) AS BIGINT) AS v
    FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL) GROUP BY user_id, t
), near AS (
  SELECT * FROM (SELECT a.t, a.node_id AS s, b.node_id AS g, sqrt((a.z - b.z) * (a.z - b.z) + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)) AS d
    FROM n a JOIN n b ON b.t = a.t + 1) WHERE d <= 2.0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY s ORDER BY d, g) AS i, row_number() OVER (PARTITION BY g ORDER BY d, s) AS j FROM near
), links AS (SELECT t, s, g, d FROM ranked WHERE i = 1 AND j = 1
), rows AS (
  SELECT 'node' AS row_type, t, node_id, z, y, x, -1 AS source_id, -1 AS target_id, NULL AS distance, -1 AS n_nodes, -1 AS n_links FROM n
  UNION ALL SELECT 'edge', t, -1, NULL, NULL, NULL, s, g, d, -1, -1 FROM links
  UNION ALL SELECT 'frame', t, -1, NULL, NULL, NULL, -1, -1, NULL, k, coalesce(m, 0) FROM (SELECT t, count(*) AS k FROM n GROUP BY t) LEFT JOIN (SELECT t, count(*) AS m FROM links GROUP BY t) USING (t)
)
SELECT 'U' AS dataset, row_type, CAST(node_id AS BIGINT) AS node_id, z, y, x, CAST(source_id AS BIGINT) AS source_id, CAST(target_id AS BIGINT) AS target_id, distance,
  CAST(n_nodes AS BIGINT) AS n_nodes, CAST(n_links AS BIGINT) AS n_links, CAST(t AS INTEGER) AS t FROM rows
"""

JOB2 = r"""
WITH RECURSIVE first AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) AS place FROM conversations WHERE conv_id IS NOT NULL AND turn BETWEEN 0 AND 999999
), said AS (
  SELECT 'part-' || ((conv_id % 16 + 16) % 16) AS dataset, conv_id * 1000000 + turn AS node_id, conv_id, turn, role,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w
  FROM first WHERE place = 1
), able AS (
  SELECT a.node_id AS s, b.node_id AS g, b.turn - a.turn AS d,
    CASE WHEN len(list_distinct(list_concat(a.w, b.w))) > 0 THEN len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / CAST(len(list_distinct(list_concat(a.w, b.w))) AS DOUBLE) ELSE 0 END AS p
  FROM said a JOIN said b ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 1 AND 3
), parents AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p DESC, d, s) AS i FROM able WHERE p >= 0.02) WHERE i = 1
), links AS (
  SELECT * FROM (SELECT s, g, p, row_number() OVER (PARTITION BY s ORDER BY p DESC, d, g) AS j FROM parents) WHERE j <= 2
), trees AS (
  SELECT node_id, node_id AS tree FROM said WHERE node_id NOT IN (SELECT g FROM links) UNION ALL SELECT l.g, t.tree FROM trees t JOIN links l ON l.s = t.node_id
)
SELECT dataset, said.node_id, conv_id, turn, role, CAST(len(w) AS BIGINT) AS n_words, coalesce(s, -1) AS parent_id, p AS probability, tree, count(*) OVER (PARTITION BY tree) AS tree_size
FROM said JOIN trees USING (node_id) LEFT JOIN links ON g = said.node_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_track_ledger": job1_track_ledger, "job2_reply_trees": job2_reply_trees}


def oracle_sql() -> dict[str, str]:
    return {"job1_track_ledger": JOB1, "job2_reply_trees": JOB2}

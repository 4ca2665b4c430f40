"""Queries on voxel tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cladeframe.operators import image as I
from cladeframe.operators.graph import frame_pairs
from cladeframe.plans.registry import query
from cladeframe.sources import adapters as A
from cladeframe.sources.adapters import with_tables

SAME = "{0}.dataset = {1}.dataset AND {0}.c = {1}.c AND {0}.t = {1}.t"
NEAR = "FROM v a JOIN v b ON " + SAME.format("a", "b") + " AND abs(a.z - b.z) <= {0} AND abs(a.y - b.y) <= {1} AND abs(a.x - b.x) <= {2}"
OWN = "a.dataset, a.c, a.t, a.z, a.y, a.x, a.value"
GROUP = " GROUP BY " + OWN
PEAKS = "pk AS (SELECT " + OWN + " " + NEAR.format(1, 1, 1) + " WHERE a.value >= 80" + GROUP + " HAVING a.value = max(b.value))"
VOXEL = "dataset, c, t, z, y, x"


def _int(df):
    return df.select(*(F.col(c).cast("int").alias(c) if c in ("t", "z", "y", "x") else F.col(c) for c in df.columns))


def _peaks(spark, d):
    return I.peaks(A.volume(spark, d), 80.0)


@query(with_tables("v", PEAKS + " SELECT * FROM pk"))
def img1_local_maxima(spark, d):
    return _int(_peaks(spark, d))


#: Greedy by recursion: a peak goes when a better one that stays is too near; both are known once all better neighbours are.
SUPPRESS = """, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, c, t ORDER BY value DESC, z, y, x) AS r FROM pk),
  s AS (SELECT dataset, c, t, 0 AS n, CAST([] AS STRUCT(z INTEGER, y INTEGER, x INTEGER)[]) AS kept FROM (SELECT DISTINCT dataset, c, t FROM r)
    UNION ALL SELECT s.dataset, s.c, s.t, n + 1, CASE WHEN len(list_filter(kept, lambda k: sqrt(((k.z - r.z) * 1.625) ** 2 + ((k.y - r.y) * 0.40625) ** 2 + ((k.x - r.x) * 0.40625) ** 2) < 2.0)) = 0
      THEN list_append(kept, {'z': r.z, 'y': r.y, 'x': r.x}) ELSE kept END FROM s JOIN r ON """ + SAME.format("s", "r") + """ AND r.r = s.n + 1)
  SELECT r.dataset, r.c, r.t, r.z, r.y, r.x, r.value FROM (SELECT dataset, c, t, arg_max(kept, n) AS kept FROM s GROUP BY ALL) l JOIN r ON """ + SAME.format("l", "r") + """ AND list_contains(kept, {'z': r.z, 'y': r.y, 'x': r.x})"""


@query(with_tables("v", PEAKS + SUPPRESS, recursive=True))
def img2_suppressed_peaks(spark, d):
    return _int(I.suppress(_peaks(spark, d), 2.0, (1.625, 0.40625, 0.40625)))


def _kernel(name, sigma):
    r = int(4 * sigma + 0.5)
    return f"{name} AS (SELECT CAST(d AS INTEGER) AS d, exp(-0.5 * (d / {sigma!r}) ** 2) / (SELECT sum(exp(-0.5 * (q / {sigma!r}) ** 2)) FROM range(-{r}, {r + 1}) s(q)) AS w FROM range(-{r}, {r + 1}) k(d))"


def _blur(name, sigma):
    """A Gaussian along z, y and x (the z axis twice as coarse, its size by frame k), borders mirrored."""
    out, last = "", "iv"
    for axis, n, s in (("z", "f.n", sigma / 2), ("y", "8", sigma), ("x", "8", sigma)):
        k, step = f"k_{name}_{axis}", f"{name}_{axis}"
        turn = f"(((a.{axis} + k.d) % (2 * {n})) + 2 * {n}) % (2 * {n})"
        at = f"CASE WHEN {turn} < {n} THEN {turn} ELSE 2 * {n} - 1 - ({turn}) END"
        rest = " AND ".join(f"b.{o} = a.{o}" for o in "zyx" if o != axis)
        out += f", {_kernel(k, s)}, {step} AS (SELECT a.k, a.z, a.y, a.x, sum(b.value * k.w) AS value FROM {last} a JOIN f ON f.k = a.k, {k} k JOIN {last} b ON b.k = a.k AND {rest} AND b.{axis} = {at} GROUP BY ALL)"
        last = step
    return out


@query(with_tables("v", "iv AS (SELECT CAST(substr(dataset, 2) AS INTEGER) * 6 + c * 3 + t AS k, z, y, x, value FROM v), f AS (SELECT k, max(z) + 1 AS n FROM iv GROUP BY ALL)" + "".join(_blur(n, s) for n, s in (("g1", 1.0), ("h1", 1.6), ("g2", 2.0), ("h2", 3.2))) + """
  SELECT 'V' || (k // 6) AS dataset, (k // 3) % 2 AS c, k % 3 AS t, z, y, x, round(greatest(g1_x.value - h1_x.value, g2_x.value - h2_x.value), 6) AS value FROM g1_x JOIN h1_x USING (k, z, y, x) JOIN g2_x USING (k, z, y, x) JOIN h2_x USING (k, z, y, x)"""))
def img3_blob_response(spark, d):
    return I.blob_response(A.volume(spark, d), [1.0, 2.0], 1.6, (2.0, 1.0, 1.0)).withColumn("value", F.round("value", 6))


CENTROID = """, w AS (SELECT k.dataset, k.c, k.t, k.z, k.y, k.x, b.z AS bz, b.y AS b_y, b.x AS bx, b.value - min(b.value) OVER (PARTITION BY k.dataset, k.c, k.t, k.z, k.y, k.x) AS w FROM pk k JOIN v b ON """ + SAME.format("k", "b") + """ AND abs(k.z - b.z) <= {0} AND abs(k.y - b.y) <= {1} AND abs(k.x - b.x) <= {1})
  SELECT """ + VOXEL + """, round(sum(w * bz) / sum(w), 6) AS cz, round(sum(w * b_y) / sum(w), 6) AS cy, round(sum(w * bx) / sum(w), 6) AS cx FROM w GROUP BY ALL"""


def _centres(spark, d, radii):
    df = I.centroids(_peaks(spark, d), A.volume(spark, d), radii)
    return _int(df.select("dataset", "c", "t", "z", "y", "x", *(F.round(c, 6).alias(c) for c in ("cz", "cy", "cx"))))


@query(with_tables("v", PEAKS + CENTROID.format(1, 2)))
def img4_centroids(spark, d):
    return _centres(spark, d, (1, 2, 2))


@query(with_tables("v", PEAKS + CENTROID.format(2, 3)))
def img5_physical_centroids(spark, d):
    return _centres(spark, d, I.physical_radii(3.0, (1.625, 1.0, 1.0)))


@query(with_tables("v", "SELECT " + OWN + " " + NEAR.format(3, 3, 3) + " AND (a.z - b.z) * (a.z - b.z) * 4 + (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 9 WHERE a.value >= 70" + GROUP + " HAVING a.value = max(b.value)"))
def img6_ball_maxima(spark, d):
    return _int(I.peaks(A.volume(spark, d), 70.0, I.ball(3.0, (2.0, 1.0, 1.0))))


@query(with_tables("v", PEAKS + " SELECT " + VOXEL + ", value FROM (SELECT *, row_number() OVER (PARTITION BY dataset, c, t ORDER BY value DESC, z, y, x) AS r FROM pk) WHERE r <= 5"))
def img7_budget(spark, d):
    return _int(I.budget(_peaks(spark, d), 5))


@query(with_tables("v", PEAKS + " SELECT v.dataset, v.c, v.t, v.z, v.y, v.x, round(max(exp(-((v.z - k.z) * (v.z - k.z) + (v.y - k.y) * (v.y - k.y) + (v.x - k.x) * (v.x - k.x)) / 4.5)), 6) AS target FROM pk k JOIN v ON " + SAME.format("v", "k") + " AND abs(v.z - k.z) <= 2 AND abs(v.y - k.y) <= 2 AND abs(v.x - k.x) <= 2 GROUP BY ALL"))
def img8_gaussian_target(spark, d):
    return _int(I.gaussian_target(_peaks(spark, d), A.volume(spark, d), 1.5, 2).withColumn("target", F.round("target", 6)))


GRID = "gz AS (SELECT unnest([0, 2]) AS z0), gy AS (SELECT unnest([0, 5, 7]) AS y0), gx AS (SELECT unnest([0, 4, 8]) AS x0)"


def _starts_sql(axis, patch, stride):
    last = f"greatest(n{axis} - {patch}, 0)"
    return f"g{axis} AS (SELECT DISTINCT dataset, CAST(unnest(list_append(generate_series(0, {last}, {stride}), {last})) AS INTEGER) AS {axis}0 FROM s)"


@query(with_tables("v", "s AS (SELECT dataset, max(z) + 1 AS nz, max(y) + 1 AS ny, max(x) + 1 AS nx FROM v GROUP BY 1), " + ", ".join(_starts_sql(*a) for a in (("z", 4, 4), ("y", 5, 4), ("x", 4, 3))) + " SELECT dataset, z0, y0, x0 FROM gz JOIN gy USING (dataset) JOIN gx USING (dataset)"))
def img9_patch_grid(spark, d):
    shapes = A.volume(spark, d).groupBy("dataset").agg(*((F.max(a) + 1).alias(f"n{a}") for a in "zyx"))
    return I.patch_grid(shapes, (F.col("nz"), F.col("ny"), F.col("nx")), (4, 5, 4), (4, 4, 3)).select("dataset", "z0", "y0", "x0")


@query(with_tables("e", "f AS (SELECT DISTINCT dataset, t FROM e), p AS (SELECT * FROM (SELECT dataset, t AS t0, lead(t) OVER (PARTITION BY dataset ORDER BY t) AS t1 FROM f) WHERE t1 IS NOT NULL), " + GRID + " SELECT dataset, t0, t1, z0, y0, x0, row_number() OVER (PARTITION BY dataset ORDER BY t0, z0, y0, x0) - 1 AS index FROM p, gz, gy, gx"))
def img10_pair_index(spark, d):
    return I.pair_index(frame_pairs(A.nodes(spark, d)), (6, 12, 12), (4, 5, 4), (4, 5, 4))


def _points(spark, d):
    """A point near every frame's every third voxel of the first plane's diagonal, some beyond the border."""
    v = F.col("vec_id")
    return A.read(spark, d, "embeddings").select(
        v.alias("node_id"), F.concat(F.lit("V"), F.floor(v / 36).cast("string")).alias("dataset"), (F.floor(v / 18) % 2).cast("int").alias("c"), (F.floor(v / 6) % 3).cast("int").alias("t"),
        (v % 6).cast("int").alias("z"), (v * 5 % 8).cast("int").alias("y"), (v * 7 % 10).cast("int").alias("x"),
    )


POINTS = "pt AS (SELECT vec_id AS node_id, 'V' || (vec_id // 36) AS dataset, CAST((vec_id // 18) % 2 AS INTEGER) AS c, CAST((vec_id // 6) % 3 AS INTEGER) AS t, CAST(vec_id % 6 AS INTEGER) AS z, CAST(vec_id * 5 % 8 AS INTEGER) AS y, CAST(vec_id * 7 % 10 AS INTEGER) AS x FROM embeddings)"
AROUND = "FROM pt JOIN v b ON " + SAME.format("pt", "b") + " AND abs(pt.z - b.z) <= 1 AND abs(pt.y - b.y) <= 2 AND abs(pt.x - b.x) <= 2"


@query(with_tables("v", POINTS + ", lo AS (SELECT node_id, quantile_cont(b.value, 0.2) AS lo " + AROUND + """ GROUP BY 1), w AS (SELECT pt.*, greatest(b.value - lo.lo, 0) AS w, b.z AS bz, b.y AS b_y, b.x AS bx """ + AROUND.replace("FROM pt", "FROM pt JOIN lo USING (node_id)") + """),
  c AS (SELECT dataset, c, node_id, t, z, y, x, sum(w) AS s, sum(w * bz) / sum(w) AS cz, sum(w * b_y) / sum(w) AS cy, sum(w * bx) / sum(w) AS cx FROM w GROUP BY ALL),
  k AS (SELECT *, s > 0 AND sqrt((cz - z) * 1.625 * ((cz - z) * 1.625) + (cy - y) * (cy - y) + (cx - x) * (cx - x)) <= 0.8 AS ok FROM c)
  SELECT dataset, c, node_id, t, round(CASE WHEN ok THEN cz ELSE z END, 6) AS z, round(CASE WHEN ok THEN cy ELSE y END, 6) AS y, round(CASE WHEN ok THEN cx ELSE x END, 6) AS x FROM k"""))
def img11_refined_midpoints(spark, d):
    df = I.refine_midpoint(_points(spark, d), A.volume(spark, d), (1, 2, 2), (1.625, 1.0, 1.0), 0.8)
    return df.select("dataset", "c", "node_id", "t", *(F.round(a, 6).alias(a) for a in "zyx"))


@query(with_tables("v", POINTS + ", q AS (SELECT node_id, dataset, c, t, z, y + CASE WHEN node_id % 5 = 0 THEN 90 ELSE 0 END AS y, x FROM pt) SELECT q.dataset, q.c, q.t, q.node_id, coalesce(max(b.value) >= 90, TRUE) AS accepted FROM q LEFT JOIN v b ON " + SAME.format("q", "b") + " AND abs(q.z - b.z) <= 1 AND abs(q.y - b.y) <= 1 AND abs(q.x - b.x) <= 1 GROUP BY ALL"))
def img12_heat_veto(spark, d):
    p = _points(spark, d).withColumn("y", (F.col("y") + F.when(F.col("node_id") % 5 == 0, 90).otherwise(0)).cast("int"))
    return I.heat_accepts(p, A.volume(spark, d), (1, 1, 1), 90.0)


@query()
def img13_segments(spark, d):
    """Voxels by cell."""
    cells = I.segment(A.volume(spark, d), 2.0).filter("label > 0")
    return cells.groupBy("dataset", "c", "t", "label").agg(F.count(F.lit(1)).alias("voxels"), F.min("z").alias("z"), F.min("y").alias("y"), F.min("x").alias("x"))


@query(with_tables("v", """sm AS (SELECT dataset, c, t, z // 2 AS z, y // 2 AS y, x // 2 AS x, value FROM v WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0), n AS (SELECT dataset, c, t, max(z) AS nz, max(y) AS ny, max(x) AS nx FROM sm GROUP BY ALL),
  o AS (SELECT CAST(a AS INTEGER) AS dz, CAST(b AS INTEGER) AS dy, CAST(f AS INTEGER) AS dx FROM range(-1, 2) p(a), range(-1, 2) q(b), range(-1, 2) r(f)),
  fl AS (SELECT s.dataset, s.c, s.t, s.z, s.y, s.x, sum(b.value) / 27 AS value FROM sm s JOIN n USING (dataset, c, t), o JOIN sm b ON """ + SAME.format("b", "s") + """
    AND b.z = least(greatest(s.z + dz, 0), nz) AND b.y = least(greatest(s.y + dy, 0), ny) AND b.x = least(greatest(s.x + dx, 0), nx) GROUP BY ALL),
  th AS (SELECT dataset, c, t, avg(value) + stddev_pop(value) AS th FROM fl GROUP BY ALL),
  pk AS (SELECT a.dataset, a.c, a.t, a.z, a.y, a.x, a.value FROM fl a JOIN th USING (dataset, c, t) JOIN fl b ON """ + SAME.format("b", "a") + """ AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 3 AND abs(a.x - b.x) <= 3 WHERE a.value >= th GROUP BY ALL HAVING a.value = max(b.value)),
  k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, c, t ORDER BY value DESC, z, y, x) AS r FROM pk) WHERE r <= 20),
  w AS (SELECT k.*, b.z AS bz, b.y AS b_y, b.x AS bx, b.value - min(b.value) OVER (PARTITION BY k.dataset, k.c, k.t, k.z, k.y, k.x) AS w FROM k JOIN fl b ON """ + SAME.format("b", "k") + """ AND abs(k.z - b.z) <= 1 AND abs(k.y - b.y) <= 3 AND abs(k.x - b.x) <= 3)
  SELECT dataset, c, t, round(sum(w * bz) / sum(w) * 2, 6) AS z, round(sum(w * b_y) / sum(w) * 2, 6) AS y, round(sum(w * bx) / sum(w) * 2, 6) AS x, round(any_value(value), 6) AS value FROM w GROUP BY dataset, c, t, w.z, w.y, w.x"""))
def img14_rule_peaks(spark, d):
    df = I.rule_peaks(A.volume(spark, d), limit=20)
    return df.select("dataset", "c", "t", *(F.round(a, 6).alias(a) for a in ("z", "y", "x", "value")))


@query(with_tables("v", "SELECT " + OWN + " " + NEAR.format(1, 2, 2) + " WHERE a.value > 80" + GROUP + " HAVING a.value = max(b.value)"))
def img15_strict_box_peaks(spark, d):
    return _int(I.peaks(A.volume(spark, d), 80.0, I.box((1, 2, 2)), strict=True))


@query(with_tables("v", "SELECT " + VOXEL + ", value FROM v"))
def prj8_d4_round_trip(spark, d):
    return _int(I.merge_views(I.views(A.volume(spark, d), 8, I.VIEWS["d4"]), 8, I.VIEWS["d4"]))


@query(with_tables("v", " UNION ALL ".join(f"SELECT {i} AS view, dataset, c, t, z, {y} AS y, {x} AS x, value FROM v" for i, (y, x) in enumerate((("y", "x"), ("7 - x", "y"), ("7 - y", "7 - x"), ("x", "7 - y"))))))
def prj14_rotations(spark, d):
    return _int(I.views(A.volume(spark, d), 8, I.VIEWS["rotations"]))


@query(with_tables("v", "SELECT dataset, c, t, z, y // 3 AS y, x // 3 AS x, round(avg(value), 6) AS value FROM v GROUP BY ALL"))
def flt3_pooled(spark, d):
    return _int(I.pool_xy(A.volume(spark, d), 3).withColumn("value", F.round("value", 6)))


@query(with_tables("v", "q AS (SELECT dataset, c, t, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM v GROUP BY ALL) SELECT " + VOXEL + ", round(least(greatest((value - lo) / greatest(hi - lo, 1e-9), 0), 1), 6) AS value FROM v JOIN q USING (dataset, c, t)"))
def flt3_normalized(spark, d):
    return _int(I.normalize(A.volume(spark, d), 0.05, 0.95).withColumn("value", F.round("value", 6)))

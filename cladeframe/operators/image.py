"""Operators on voxel tables (dataset, c, t, z, y, x, value) and on peak tables.

A frame is a value of those of ``dataset``, ``c`` (channel) and ``t`` that a
table has; no operator mixes frames.  Neighbourhoods are fixed integer
offsets, so they are equi-joins on shifted coordinates; suppression works in
rounds over near pairs.  Separable filters of large reach, distances and floods
run on blocks of voxels (``operators.blocks``).
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.operators import blocks as B
from cladeframe.operators.quantiles import quantiles
from cladeframe.operators.spatial import radius_join
from cladeframe.scratch import remove, stored

AXES = ("z", "y", "x")


def frame(df: DataFrame) -> list[str]:
    """The columns of ``df`` that name a frame."""
    return [c for c in ("dataset", "c", "t") if c in df.columns]


def box(radii: tuple[int, int, int]) -> list[tuple[int, int, int]]:
    return list(itertools.product(*(range(-r, r + 1) for r in radii)))


def ball(radius: float, voxel: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Offsets within ``radius`` in physical units."""
    radii = tuple(math.floor(radius / v) for v in voxel)
    return [o for o in box(radii) if sum((d * v) ** 2 for d, v in zip(o, voxel)) <= radius * radius + 1e-12]


def around(points: DataFrame, voxels: DataFrame, offsets: list[tuple[int, int, int]], key: list[str]) -> DataFrame:
    """Every point's voxels at the given offsets: the point's ``key``, frame, z, y, x, offsets dz, dy, dx and the voxel's value."""
    own = frame(points)
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for d, a in zip(o, AXES))) for o in offsets))
    spread = points.select(*key, *own, *AXES, F.explode(steps).alias("_o")).select(
        *key, *own, *AXES, *(F.col(f"_o.d{a}").alias(f"d{a}") for a in AXES), *((F.col(a) + F.col(f"_o.d{a}")).alias(f"_{a}") for a in AXES)
    )
    there = voxels.select(*own, *(F.col(a).alias(f"_{a}") for a in AXES), F.col("value").alias("near"))
    return spread.join(there, [*own, *(f"_{a}" for a in AXES)]).drop(*(f"_{a}" for a in AXES))


def peaks(voxels: DataFrame, threshold: float, offsets: list[tuple[int, int, int]] | None = None, strict: bool = False) -> DataFrame:
    """Voxels that reach the threshold (strict: exceed it) and the maximum of their neighbourhood: frame, z, y, x, value."""
    offsets = offsets or box((1, 1, 1))
    hot = voxels.filter(F.col("value") > threshold if strict else F.col("value") >= threshold)
    return local_tops(hot, voxels, offsets)


def local_tops(hot: DataFrame, voxels: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    own = frame(voxels)
    best = around(hot.withColumn("_v", F.col("value")), voxels, offsets, ["_v"]).groupBy(*own, *AXES, "_v").agg(F.max("near").alias("_m"))
    return best.filter("_v = _m").select(*own, *AXES, F.col("_v").alias("value"))


def suppress(found: DataFrame, distance: float, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Peaks kept greedily by (larger value, z, y, x), each at least ``distance`` from those kept before.

    In rounds over the pairs that are nearer: a peak without a better one near
    it is kept and its worse neighbours go, until no pair has two open ends.
    """
    if distance <= 0:
        return found
    kept = stored(found.withColumn("_n", F.monotonically_increasing_id()), "peaks")
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in frame(found))) if frame(found) else F.lit("")
    points = kept.select(name.alias("dataset"), F.lit(0).alias("t"), F.col("_n").alias("node_id"), *(F.col(a).cast("double").alias(a) for a in AXES), F.struct(-F.col("value"), *AXES, "_n").alias("place"))
    near = radius_join(points, points, distance, 0, scale, keep=("place",)).filter(F.col("distance") < distance)
    pairs = stored(near.filter("left_place < right_place").select(F.col("left_id").alias("a"), F.col("right_id").alias("b")), "near-peaks")
    lost = None
    while not pairs.isEmpty():
        best = pairs.select("a").distinct().join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        gone = stored(pairs.join(best, "a", "left_semi").select(F.col("b").alias("x")).distinct(), "lost-peaks")
        lost = gone if lost is None else lost.unionByName(gone)
        rest = pairs.join(best, "a", "left_anti").join(gone.withColumnRenamed("x", "a"), "a", "left_anti").join(gone.withColumnRenamed("x", "b"), "b", "left_anti")
        was, pairs = pairs, stored(rest.select("a", "b"), "near-peaks")
        remove(was)
    remove(pairs)
    return (kept if lost is None else kept.join(lost.withColumnRenamed("x", "_n"), "_n", "left_anti")).select(*found.columns)


def centroids(found: DataFrame, voxels: DataFrame, radii: tuple[int, int, int]) -> DataFrame:
    """Peaks with the intensity-weighted centre of their box, values taken above the box's minimum; the peak itself where all are equal."""
    own = frame(found)
    near = around(found, voxels, box(radii), [])
    low = F.min("near").over(Window.partitionBy(*own, *AXES))
    near = near.withColumn("_w", F.col("near") - low)
    total = F.sum("_w")
    centre = [F.when(total > 0, F.sum(F.col("_w") * (F.col(a) + F.col(f"d{a}"))) / total).otherwise(F.first(a).cast("double")).alias(f"c{a}") for a in AXES]
    return near.groupBy(*own, *AXES).agg(*centre)


def physical_radii(radius: float, voxel: tuple[float, float, float]) -> tuple[int, int, int]:
    return tuple(math.ceil(radius / v) for v in voxel)


def budget(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*frame(found)).orderBy(F.desc("value"), *AXES)
    return found.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def gaussian_target(centres: DataFrame, voxels: DataFrame, sigma: float, radius: int) -> DataFrame:
    """Largest exp(-d^2 / 2 sigma^2) of the centres whose window holds a voxel: frame, z, y, x, target."""
    own = frame(centres)
    near = around(centres, voxels, box((radius,) * 3), [])
    d2 = F.col("dz") * F.col("dz") + F.col("dy") * F.col("dy") + F.col("dx") * F.col("dx")
    return near.select(*own, *((F.col(a) + F.col(f"d{a}")).alias(a) for a in AXES), F.exp(-d2 / (2.0 * sigma * sigma)).alias("_g")).groupBy(*own, *AXES).agg(F.max("_g").alias("target"))


def starts(size: int | Column, patch: int, stride: int) -> Column:
    """Patch starts along an axis: every stride, the last one moved back to the border."""
    last = F.greatest((F.lit(size) if isinstance(size, int) else size) - patch, F.lit(0)).cast("int")
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def patch_grid(one: DataFrame, shape: tuple[int | Column, int | Column, int | Column], patch: tuple[int, int, int], stride: tuple[int, int, int]) -> DataFrame:
    """All patch offsets z0, y0, x0 for every row of ``one``; the shape may differ by row."""
    df = one
    for a, n, p, s in zip(AXES, shape, patch, stride):
        df = df.withColumn(f"{a}0", F.explode(starts(n, p, s)))
    return df


def patch_starts(size: int, patch: int, stride: int) -> list[int]:
    last = max(size - patch, 0)
    return sorted({*range(0, last + 1, stride), last})


def pair_index(pairs: DataFrame, shape: tuple[int, int, int], patch: tuple[int, int, int], stride: tuple[int, int, int]) -> DataFrame:
    """Frame pairs (dataset, t0, t1) by patch with a running index by (dataset, t0, z0, y0, x0): the pair's rank times the patches, plus the patch."""
    grid = list(itertools.product(*(patch_starts(n, p, s) for n, p, s in zip(shape, patch, stride))))
    ranked = pairs.withColumn("_r", F.row_number().over(Window.partitionBy("dataset").orderBy("t0")) - 1)  # a row a frame
    offsets = F.array(*(F.struct(*(F.lit(v).alias(f"{a}0") for v, a in zip(o, AXES))) for o in grid))
    each = ranked.select(*pairs.columns, "_r", F.posexplode(offsets).alias("_p", "_o"))
    return each.select(*pairs.columns, *(F.col(f"_o.{a}0") for a in AXES), (F.col("_r").cast("bigint") * len(grid) + F.col("_p")).alias("index"))


def refine_midpoint(points: DataFrame, voxels: DataFrame, radii: tuple[int, int, int], scale: tuple[float, float, float], max_shift: float = 3.2, quantile: float = 0.2) -> DataFrame:
    """Centroid of the patch above its 20th percentile; the point stays where the shift is too large or nothing is left."""
    own = [*frame(points), "node_id"]
    near = around(points, voxels, box(radii), ["node_id"])
    low = near.groupBy(*own).agg(F.expr(f"percentile(near, {quantile})").alias("_low"))
    w = F.greatest(F.col("near") - F.col("_low"), F.lit(0.0))
    near = near.join(low, own).withColumn("_w", w)
    total = F.sum("_w")
    fit = near.groupBy(*own, *AXES).agg(total.alias("_t"), *((F.sum(F.col("_w") * (F.col(a) + F.col(f"d{a}"))) / total).alias(f"_c{a}") for a in AXES))
    shift = F.sqrt(sum((((F.col(f"_c{a}") - F.col(a)) * s) * ((F.col(f"_c{a}") - F.col(a)) * s) for a, s in zip(AXES, scale)), F.lit(0.0)))
    fine = (F.col("_t") > 0) & (shift <= max_shift)
    return fit.select(*own, *(F.when(fine, F.col(f"_c{a}")).otherwise(F.col(a).cast("double")).alias(a) for a in AXES))


def heat_accepts(points: DataFrame, voxels: DataFrame, radii: tuple[int, int, int], threshold: float) -> DataFrame:
    """frame, node_id, accepted: the window's maximum reaches the threshold; a point without any voxel is accepted."""
    own = [*frame(points), "node_id"]
    top = around(points, voxels, box(radii), ["node_id"]).groupBy(*own).agg(F.max("near").alias("_m"))
    return points.join(top, own, "left").select(*own, F.coalesce(F.col("_m") >= threshold, F.lit(True)).alias("accepted"))


def pool_xy(voxels: DataFrame, factor: int) -> DataFrame:
    return voxels.groupBy(*frame(voxels), "z", F.floor(F.col("y") / factor).cast("int").alias("y"), F.floor(F.col("x") / factor).cast("int").alias("x")).agg(F.avg("value").alias("value"))


def normalize(voxels: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values between two quantiles of their frame, as [0, 1]; the quantiles are exact."""
    own = frame(voxels)
    q = quantiles(voxels, own, "value", {"_lo": low, "_hi": high})
    v = (F.col("value") - F.col("_lo")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-9))
    return voxels.join(q, own).select(*own, *AXES, F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)).alias("value"))


#: Rotation by k quarter turns, then optional flip of x, of an n by n image: where (y, x) goes.
def d4(k: int, flip: bool, n: int, y: Column, x: Column) -> tuple[Column, Column]:
    for _ in range(k % 4):
        y, x = (n - 1) - x, y
    return (y, (n - 1) - x) if flip else (y, x)


def d4_inverse(k: int, flip: bool, n: int, y: Column, x: Column) -> tuple[Column, Column]:
    if flip:
        x = (n - 1) - x
    for _ in range(k % 4):
        y, x = x, (n - 1) - y
    return y, x


VIEWS = {
    "d4": [(k, f) for f in (False, True) for k in range(4)],
    "flips": [(0, False), (0, True), (2, True), (2, False)],
    "rotations": [(k, False) for k in range(4)],
}


def views(voxels: DataFrame, n: int, names: list[tuple[int, bool]]) -> DataFrame:
    """The transformed copies of every (y, x) plane, with the number of the view."""
    out = None
    for i, (k, flip) in enumerate(names):
        y, x = d4(k, flip, n, F.col("y"), F.col("x"))
        one = voxels.select(F.lit(i).alias("view"), *frame(voxels), "z", y.alias("y"), x.alias("x"), "value")
        out = one if out is None else out.unionByName(one)
    return out


def merge_views(stacked: DataFrame, n: int, names: list[tuple[int, bool]]) -> DataFrame:
    """Every view turned back and averaged."""
    back_y, back_x = F.lit(None).cast("int"), F.lit(None).cast("int")
    for i, (k, flip) in enumerate(names):
        y, x = d4_inverse(k, flip, n, F.col("y"), F.col("x"))
        back_y, back_x = F.when(F.col("view") == i, y).otherwise(back_y), F.when(F.col("view") == i, x).otherwise(back_x)
    own = frame(stacked)
    return stacked.select(*own, "z", back_y.alias("y"), back_x.alias("x"), "value").groupBy(*own, "z", "y", "x").agg(F.avg("value").alias("value"))


def gauss(a: np.ndarray, sigmas: tuple[float, ...]) -> np.ndarray:
    """Separable Gaussian with a sigma an axis, window of 4 sigma, borders mirrored."""
    for axis, sigma in enumerate(sigmas):
        if sigma <= 0:
            continue
        r = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
        pad = np.moveaxis(np.pad(a, [(r, r) if i == axis else (0, 0) for i in range(a.ndim)], mode="symmetric"), axis, 0)
        n = a.shape[axis]
        a = np.moveaxis(sum(w * pad[i : i + n] for i, w in enumerate(k / k.sum())), 0, axis)
    return a


def blob_response(voxels: DataFrame, sigmas: list[float], ratio: float = 1.6, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), edge: int = B.EDGE) -> DataFrame:
    """Largest difference of Gaussians over several scales, by frame; ``sigmas`` in physical units, ``voxel`` the size of a voxel.

    In blocks of ``edge`` voxels, a channel a Gaussian; voxels that are missing inside a frame are 0 and get a value.
    """
    widths = [w for s in sigmas for w in (s, s * ratio)]

    def blur(a: np.ndarray, axis: int) -> np.ndarray:
        each = a if len(a) == len(widths) else [a[0]] * len(widths)
        return np.stack([gauss(v, tuple(w / voxel[axis] if i == axis else 0.0 for i in range(3))) for v, w in zip(each, widths)])

    def response(a, _):
        a = blur(a, 2)
        return (a[::2] - a[1::2]).max(0, keepdims=True)

    cut = B.along(B.along(B.blocks(voxels, edge), 0, lambda a, _: blur(a[:1], 0), edge), 1, lambda a, _: blur(a, 1), edge)
    return B.voxels_of(B.along(cut, 2, response, edge), [(0, "value")], edge)


def rule_peaks(voxels: DataFrame, threshold: float = 0.0, stride: int = 2, limit: int = 800) -> DataFrame:
    """Peaks by fixed rules: frame, z, y, x (refined, in voxels of the input), value.

    Every axis is subsampled; means of 3 x 3 x 3 with mirrored borders; maxima
    of a (3, 7, 7) window that reach the threshold, or without one the frame's
    mean plus its standard deviation; the best ``limit`` a frame; the centre of
    the window's means above its least one (0 where all are equal).
    """
    own = frame(voxels)
    thin = F.lit(True)
    for a in AXES:
        thin &= F.col(a) % stride == 0
    small = voxels.filter(thin).select(*own, *((F.col(a) / stride).cast("int").alias(a) for a in AXES), "value")
    last = small.groupBy(*own).agg(*(F.max(a).alias(f"_n{a}") for a in AXES))
    steps = F.array(*(F.struct(*(F.lit(d).alias(f"d{a}") for d, a in zip(o, AXES))) for o in box((1, 1, 1))))
    spread = small.join(last, own).withColumn("_o", F.explode(steps))
    # a voxel's value goes to each voxel whose window holds it, and once more across a border for each axis on it
    spread = spread.select(*own, *((F.col(a) + F.col(f"_o.d{a}")).alias(a) for a in AXES), *(f"_n{a}" for a in AXES), "value", *(F.col(a).alias(f"_{a}") for a in AXES))
    inside, times = F.lit(True), F.lit(1)
    for a in AXES:
        inside &= F.col(a).between(F.lit(0), F.col(f"_n{a}"))
        edge = ((F.col(f"_{a}") == 0) & (F.col(a) == 0)).cast("int") + ((F.col(f"_{a}") == F.col(f"_n{a}")) & (F.col(a) == F.col(f"_n{a}"))).cast("int")
        times = times * (1 + edge)
    flat = spread.filter(inside).groupBy(*own, *AXES).agg((F.sum(F.col("value") * times) / 27).alias("value"))
    flat = stored(flat, "rule-means")
    if threshold > 0:
        hot = flat.filter(F.col("value") >= threshold)
    else:
        least = flat.groupBy(*own).agg((F.avg("value") + F.stddev_pop("value")).alias("_least"))
        hot = flat.join(least, own).filter(F.col("value") >= F.col("_least")).drop("_least")
    window = box((1, 3, 3))
    best = budget(local_tops(hot, flat, window), limit)
    near = around(best.withColumn("_v", F.col("value")), flat, window, ["_v"])
    near = near.withColumn("_w", F.col("near") - F.min("near").over(Window.partitionBy(*own, *AXES)))
    total = F.sum("_w")
    whole = F.when(total == 0, F.lit(1.0)).otherwise(total)
    centre = near.groupBy(*own, *(F.col(a).alias(f"_{a}") for a in AXES), F.col("_v").alias("value")).agg(*((F.sum(F.col("_w") * (F.col(a) + F.col(f"d{a}"))) / whole * stride).alias(a) for a in AXES))
    return centre.select(*own, *AXES, "value")


def otsu(n: np.ndarray, low: float, high: float) -> float:
    """The centre of the bin after which two classes differ most; ``n`` counts values in equal bins from ``low`` to ``high``."""
    edges = np.histogram_bin_edges([], len(n), (low, high))
    mid = (edges[1:] + edges[:-1]) / 2
    below, above = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        mean_below, mean_above = np.cumsum(n * mid) / below, (np.cumsum((n * mid)[::-1]) / above[::-1])[::-1]
    return float(mid[np.nan_to_num(below[:-1] * above[1:] * (mean_below[:-1] - mean_above[1:]) ** 2).argmax()])


def least_volume(diameter: float, voxel: tuple[float, float, float], share: float) -> float:
    """The fewest voxels of the full volume that a cell may have: a share of the ball's, each half axis at least half a voxel."""
    return 4.0 / 3.0 * math.pi * math.prod(max(diameter / 2 / v, 0.5) for v in voxel) * share


def segment(voxels: DataFrame, diameter: float, voxel: tuple[float, float, float] = (1.0, 1.0, 1.0), step: tuple[int, int, int] = (1, 1, 1), edge: int = B.EDGE) -> DataFrame:
    """Cells of every frame: frame, z, y, x, label (0: background), value (what the threshold was applied to).

    Values between the 1st and the 99.9th percentile; minus a wide Gaussian;
    difference of Gaussians for the size of a cell; Otsu's threshold (on the
    values before, if fewer than 20 are positive; no cells if these are too few
    as well); touching cells are parted by flooding from the tops of the
    distance to the border.  With ``step`` only every so many voxels along an
    axis are kept once values are scaled, and z, y, x count those.  All in
    blocks of ``edge`` voxels, which does not change the result.  Cells are
    numbered from 1 by the first voxel of their top.
    """
    unit = tuple(v * s for v, s in zip(voxel, step))
    sigma = tuple(max(0.6, diameter / 4 / u) for u in unit)
    apart = tuple(max(1, int(np.round(diameter / u))) for u in unit)

    def blur(a: np.ndarray, axis: int, times: float) -> np.ndarray:
        return gauss(a, tuple(times * sigma[axis] if i == axis else 0.0 for i in range(3)))

    name = B.frame_name(voxels)
    rows = voxels.filter(" AND ".join(f"{a} >= 0" for a in AXES)).select(name.alias("_frame"), *AXES, F.nanvl(F.coalesce(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("value"))
    counts = rows.groupBy("_frame", "value").agg(F.count(F.lit(1)).alias("_w"))
    space = F.lit(1).cast("bigint")
    for a in AXES:
        space = space * (F.max(a) + 1)
    empty = rows.groupBy("_frame").agg((space - F.count(F.lit(1))).alias("_w")).select("_frame", F.lit(0.0).alias("value"), "_w")
    counts = stored(counts.unionByName(empty), "value-counts")
    limits = quantiles(counts, ["_frame"], "value", {"low": 0.01, "high": 0.999}, "_w")
    kept = voxels
    for a, s in zip(AXES, step):
        if s > 1:
            kept = kept.filter(F.col(a) % s == 0).withColumn(a, (F.col(a) / s).cast("int"))
    cut = B.blocks(kept, edge).join(limits, "_frame")

    def scaled(a, row):
        a = np.clip((a[0] - row["low"]) / (row["high"] - row["low"] if row["high"] > row["low"] else 1.0), 0.0, 1.0)
        return np.stack([a, blur(a, 0, 10)])

    def flattened(a, _):
        return np.clip(a[:1] - blur(a[1], 2, 10), 0.0, None)

    cut = B.along(B.along(B.along(cut, 0, scaled, edge), 1, lambda a, _: np.stack([a[0], blur(a[1], 1, 10)]), edge), 2, flattened, edge)
    cut = B.along(cut, 0, lambda a, _: np.stack([a[0], blur(a[0], 0, 1), blur(a[0], 0, 1.6)]), edge)
    cut = B.along(cut, 1, lambda a, _: np.stack([a[0], blur(a[1], 1, 1), blur(a[2], 1, 1.6)]), edge)
    cut = stored(B.along(cut, 2, lambda a, _: np.stack([a[0], np.clip(blur(a[1], 2, 1) - blur(a[2], 2, 1.6), 0.0, None)]), edge).drop("low", "high"), "enhanced")

    def positive(a, _):
        each = [v[v > 0] for v in a]
        return {"channel": [0, 1], "n": [v.size for v in each], "low": [v.min() if v.size else None for v in each], "high": [v.max() if v.size else None for v in each]}

    spans = B.of_blocks(cut, ["_frame"], positive, "channel int, n bigint, low double, high double", edge).groupBy("_frame", "channel").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    used = spans.filter("n >= 20").groupBy("_frame").agg(F.max_by(F.struct("channel", "low", "high"), "channel").alias("_s")).select("_frame", "_s.*")
    used = stored(used, "used-channels")

    def binned(a, row):
        v = a[row["channel"]]
        n = np.histogram(v[v > 0], 256, (row["low"], row["high"]))[0]
        return {"bin": np.flatnonzero(n), "n": n[n > 0]}

    def threshold(pdf):
        n = np.zeros(256, np.int64)
        n[pdf.bin] = pdf.n
        return pd.DataFrame({"_frame": pdf["_frame"][:1], "least": [otsu(n, pdf.low[0], pdf.high[0])]})

    bins = B.of_blocks(cut.join(used, "_frame"), ["_frame", "low", "high"], binned, "bin int, n bigint", edge).groupBy("_frame", "low", "high", "bin").agg(F.sum("n").alias("n"))
    least = stored(bins.groupBy("_frame").applyInPandas(threshold, "_frame string, least double"), "thresholds")
    known = cut.join(used.select("_frame", "channel"), "_frame", "left").join(least, "_frame", "left").withColumns({"channel": F.coalesce("channel", F.lit(0)), "least": F.coalesce("least", F.lit(float("inf")))})

    def inside(a, row):
        a = a[int(row["channel"])]
        return np.stack([a, B.nearest(np.where(a > row["least"], B.FAR, 0.0), 0, unit[0])])

    def depth(a, _):
        far = np.sqrt(B.nearest(a[1], 2, unit[2]))
        return np.stack([a[0], far, B.widest(far, 2, apart[2])])

    deep = B.along(B.along(B.along(known, 0, inside, edge), 1, lambda a, _: np.stack([a[0], B.nearest(a[1], 1, unit[1])]), edge), 2, depth, edge)
    deep = B.along(deep, 1, lambda a, _: np.stack([a[0], a[1], B.widest(a[2], 1, apart[1])]), edge)
    deep = stored(B.along(deep, 0, lambda a, _: np.stack([a[0], a[1], (a[1] > 0) & (B.widest(a[2], 0, apart[0]) == a[1])]), edge).drop("channel", "least"), "depths")
    seeds = B.parts(deep, 2, edge)
    out = B.flood(deep, 1, 2, seeds, edge)
    remove(counts, limits, cut, used, least, deep, seeds)
    return out

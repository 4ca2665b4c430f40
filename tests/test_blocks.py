"""Quantiles by counting, and segmentation in blocks against whole arrays."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import blocks as B
from cladeframe.operators import image as I
from cladeframe.operators.quantiles import quantiles

VOXELS = "dataset string, t int, z int, y int, x int, value double"


@pytest.mark.parametrize("seed", [1, 2])
def test_quantiles_equal_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {"normal": rng.normal(size=3001), "ties": np.repeat([1.0, 1.0, 7.0, -2.0], 250), "one": np.array([4.5]), "wide": 10.0 ** rng.uniform(-200, 200, 700) * rng.choice([-1, 1], 700), "huge": np.array([-1.7e308, 0.0, 1.7e308, 5e-324])}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("normal", None), ("normal", float("nan")), ("none", None)]
    at = {"a": 0.0, "b": 0.01, "c": 0.5, "d": 0.999, "e": 1.0}
    got = {r.k: r for r in quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", at).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        if k != "huge":  # numpy overflows between its ends
            assert [got[k][n] for n in at] == pytest.approx(list(np.percentile(vs, [100 * q for q in at.values()])), rel=1e-12, abs=0)
    assert (got["huge"].a, got["huge"].e) == (-1.7e308, 1.7e308)


def test_quantiles_with_weights_and_without_rows(spark):
    df = spark.createDataFrame([(0, 1.0, 3), (0, 2.0, 1), (0, 9.0, 0), (0, 5.0, 2)], "k int, v double, w bigint")
    assert [tuple(r) for r in quantiles(df, ["k"], "v", {"q": 0.6}, "w").collect()] == [(0, 2.0)]
    assert [r.q for r in quantiles(df, [], "v", {"q": 0.5}).collect()] == [pytest.approx(3.5)]
    assert quantiles(df.limit(0), ["k"], "v", {"q": 0.5}).count() == 0


def whole_flood(height, mask, seeds):
    """Every voxel by a queue over (level, steps, label)."""
    done, queue = {}, [(height[p], 0, seeds[p], p) for p in map(tuple, np.argwhere(mask & (seeds > 0)))]
    heapq.heapify(queue)
    while queue:
        level, steps, label, p = heapq.heappop(queue)
        if p in done:
            continue
        done[p] = label
        for q in B_near(p, mask):
            if q not in done and seeds[q] == 0:
                heapq.heappush(queue, (height[q], 1, label, q) if height[q] > level else (level, steps + 1, label, q))
    out = np.zeros(mask.shape, int)
    for p, label in done.items():
        out[p] = label
    return out


def B_near(p, mask):
    for axis in range(3):
        for d in (-1, 1):
            q = (*p[:axis], p[axis] + d, *p[axis + 1 :])
            if 0 <= q[axis] < mask.shape[axis] and mask[q]:
                yield q


def whole_parts(mask):
    out, n = np.zeros(mask.shape, int), 0
    for start in map(tuple, np.argwhere(mask)):
        if not out[start]:
            n += 1
            out[start], stack = n, [start]
            while stack:
                for q in B_near(stack.pop(), mask):
                    if not out[q]:
                        out[q] = n
                        stack.append(q)
    return out


def whole_segment(a, diameter, voxel, step):
    lo, hi = np.percentile(a, [1.0, 99.9])
    a = np.clip((a - lo) / (hi - lo if hi > lo else 1.0), 0.0, 1.0)[tuple(slice(None, None, s) for s in step)]
    unit = np.array(voxel) * step
    sigma = tuple(np.maximum(0.6, diameter / 4 / unit))
    flat = np.clip(a - I.gauss(a, tuple(10 * s for s in sigma)), 0.0, None)
    work = np.clip(I.gauss(flat, sigma) - I.gauss(flat, tuple(1.6 * s for s in sigma)), 0.0, None)
    if (work > 0).sum() < 20:
        work = flat
    if (work > 0).sum() < 20:
        return np.zeros(a.shape, int)
    v = work[work > 0]
    mask = work > I.otsu(np.histogram(v, 256)[0], v.min(), v.max())
    off = np.argwhere(~mask) * unit
    far = np.zeros(mask.shape)
    for p in np.argwhere(mask):
        far[tuple(p)] = np.sqrt(((off - p * unit) ** 2).sum(1).min())
    r = np.maximum(1, np.round(diameter / unit)).astype(int)
    tops = np.zeros(mask.shape, bool)
    for p in np.argwhere(mask):
        tops[tuple(p)] = far[tuple(p)] == far[tuple(slice(max(0, c - k), c + k + 1) for c, k in zip(p, r))].max()
    return whole_flood(-far, mask, whole_parts(tops))


def blobs(shape, centres, width, noise, seed):
    rng = np.random.default_rng(seed)
    at = np.indices(shape).reshape(3, -1).T
    value = rng.uniform(0, noise, len(at))
    for c in centres:
        value += np.exp(-((at - np.array(c)) ** 2).sum(1) / width)
    return value.reshape(shape)


def table(spark, volumes):
    rows = [(*key, *map(int, p), float(a[tuple(p)])) for key, a in volumes.items() for p in np.argwhere(a != 0)]
    return spark.createDataFrame(rows, VOXELS)


def labels(df, key, shape):
    out = np.full(shape, -1)
    own = [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(("dataset", "t"), key)]
    for r in df.filter(own[0] & own[1]).collect():
        assert out[r.z, r.y, r.x] == -1
        out[r.z, r.y, r.x] = r.label
    return out


@pytest.mark.parametrize("edge", [5, 32])
def test_segments_in_blocks_equal_whole_arrays(spark, edge):
    rng = np.random.default_rng(7)
    volumes = {
        ("a", 0): blobs((9, 14, 23), [(4, 5, 5), (4, 6, 10), (5, 9, 16), (2, 10, 4)], 5.0, 0.02, 1),
        ("a", 1): blobs((6, 11, 11), rng.uniform(0, (6, 11, 11), (5, 3)), 4.0, 0.3, 2),
        (None, None): blobs((7, 12, 12), [(3, 5, 5), (3, 5, 8)], 4.0, 0.0, 3),
    }
    volumes["b", 0] = np.ones((3, 4, 6))
    out = I.segment(table(spark, volumes), 6.0, (1.5, 1.0, 1.0), edge=edge)
    assert out.columns == ["dataset", "t", "z", "y", "x", "label", "value"]
    for key, a in volumes.items():
        want = whole_segment(a, 6.0, (1.5, 1.0, 1.0), (1, 1, 1))
        assert (labels(out, key, a.shape) == want).all(), key
    assert want.max() == 0 and whole_segment(volumes["a", 0], 6.0, (1.5, 1.0, 1.0), (1, 1, 1)).max() >= 3


def test_segments_of_every_second_pixel(spark):
    a = blobs((6, 24, 26), [(3, 8, 8), (3, 8, 16), (2, 18, 9)], 10.0, 0.05, 4)
    want = whole_segment(a, 7.0, (2.0, 0.8, 0.8), (1, 2, 2))
    out = I.segment(table(spark, {("a", 0): a}), 7.0, (2.0, 0.8, 0.8), (1, 2, 2), edge=4)
    assert want.max() >= 2 and (labels(out, ("a", 0), want.shape) == want).all()
    assert I.least_volume(2.0, (1.0, 1.0, 4.0), 0.5) == pytest.approx(4 / 3 * np.pi * 0.25)


def test_segments_of_empty_and_broken_tables(spark):
    none = spark.createDataFrame([], VOXELS)
    assert I.segment(none, 5.0).count() == 0 and I.segment(none.drop("dataset", "t"), 5.0).count() == 0
    odd = spark.createDataFrame([("a", 0, 1, 1, 1, None), ("a", 0, None, 0, 0, 3.0), ("a", 0, 0, 0, 0, float("nan"))], VOXELS)
    assert {(r.z, r.y, r.x): r.label for r in I.segment(odd, 5.0).collect()} == {(z, y, x): 0 for z in (0, 1) for y in (0, 1) for x in (0, 1)}


def test_flood_goes_back_and_forth_through_blocks(spark):
    """One corridor that winds through many blocks, seeds at its ends of unequal depth."""
    a = np.zeros((1, 9, 21))
    for k in range(0, 9, 2):
        a[0, k] = 1.0
        if k < 8:
            a[0, k + 1, 20 if k % 4 == 0 else 0] = 1.0
    a[0, 0, 0], a[0, 8, 20], a[0, 4, 10] = 3.0, 2.0, 0.5
    tops = (a >= 2).astype(float)
    cut = B.blocks(table(spark, {("a", 0): a + (a == 0) * 1e-300}), 4)
    cut = B.along(cut, 0, lambda v, _: np.stack([v[0], np.where(v[0] > 1e-9, v[0], 0.0), v[0] >= 2.0]), 4)
    seeds = B.parts(cut, 2, 4)
    assert sorted(r.label for r in seeds.collect()) == [1, 2]
    assert (labels(B.flood(cut, 1, 2, seeds, 4), ("a", 0), a.shape) == whole_flood(-a, a > 0, whole_parts(tops > 0))).all()


def test_distances_and_parts_of_a_mask():
    rng = np.random.default_rng(5)
    mask = rng.random((5, 6, 7)) < 0.7
    d, unit = np.where(mask, B.FAR, 0.0), (2.0, 1.0, 1.5)
    for axis, u in enumerate(unit):
        d = B.nearest(d, axis, u)
    off = np.argwhere(~mask)
    want = [min((((p - q) * unit) ** 2).sum() for q in off) for p in np.argwhere(mask)]
    assert np.allclose(d[mask], want) and (B.nearest(np.full((2, 3, 4), B.FAR), 1, 1.0) == B.FAR).all()
    found, parts = B.parts_of(mask), whole_parts(mask)
    assert (found < 0).sum() == (~mask).sum() and len(set(zip(found[mask], parts[mask]))) == parts.max()


def test_blob_response_in_blocks_equals_whole_arrays(spark):
    volumes = {("a", 0): blobs((7, 13, 10), [(3, 4, 4), (3, 9, 6)], 6.0, 0.1, 8), (None, 1): blobs((2, 3, 3), [(0, 1, 1)], 2.0, 0.1, 9)}
    out = I.blob_response(table(spark, volumes), [1.0, 2.5], 1.6, (2.0, 1.0, 1.0), edge=4)
    assert out.columns == ["dataset", "t", "z", "y", "x", "value"]
    for key, a in volumes.items():
        want = np.max([I.gauss(a, (s / 2, s, s)) - I.gauss(a, (1.6 * s / 2, 1.6 * s, 1.6 * s)) for s in (1.0, 2.5)], axis=0)
        rows = [r for r in out.collect() if (r.dataset, r.t) == key]
        got = np.full(a.shape, np.nan)
        for r in rows:
            got[r.z, r.y, r.x] = r.value
        assert len(rows) == a.size and np.allclose(got, want, atol=1e-12)

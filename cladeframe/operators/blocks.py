"""Volumes in cubic blocks, for filters and floods that reach further than a neighbourhood.

A row holds a block: the columns of its frame and their text, the frame's shape ``nz, ny,
nx``, the block's place ``bz, by, bx`` and ``data``, doubles of one or more
channels over the block (missing voxels are 0).  A separable step runs along
one axis: blocks in a line meet in one task, so it sees whole rows of voxels
and borders only where the volume ends.  A task holds ``EDGE`` x ``EDGE``
rows, never a volume.  A flood runs in rounds inside blocks, which exchange
their faces; only blocks that were told something new run again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.graph import components
from cladeframe.scratch import placed, remove, stored

AXES = ("z", "y", "x")
SHAPE = ("nz", "ny", "nx")
PLACE = ("bz", "by", "bx")
#: Voxels along a block's edge.
EDGE = 32
#: More than any step count or label; far below the largest long.
NONE = 1 << 62
#: Squared distance where no border is known yet.
FAR = 1e18
#: Bits of a flood's step count, below the rank of its height.
STEP_BITS = 40


#: The key of a block: its frame as one text without nulls, and its place.
KEY = ("_frame", *PLACE)


def frame(df: DataFrame) -> list[str]:
    """The columns of ``df`` that name a frame."""
    return [c for c in ("dataset", "c", "t") if c in df.columns]


def frame_name(df: DataFrame) -> Column:
    own = frame(df)
    return F.to_json(F.struct(*own)) if own else F.lit("")


def schema(df: DataFrame, columns: list[str], more: str = "") -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"{c} {types[c]}" for c in columns), *([more] if more else [])])


def dealt(df: DataFrame, key: list[str] | tuple[str, ...]) -> DataFrame:
    """``df`` by ``key`` in all shuffle partitions: groups are few bytes and much work, so small partitions shall not be merged."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def size(row, axis: int, edge: int) -> int:
    return min(edge, int(row[SHAPE[axis]]) - int(row[PLACE[axis]]) * edge)


def values(row, edge: int) -> np.ndarray:
    """A block's channels: an array (channel, z, y, x)."""
    return np.frombuffer(row["data"], "<f8").reshape(-1, *(size(row, a, edge) for a in range(3)))


def blocks(voxels: DataFrame, edge: int = EDGE) -> DataFrame:
    """All blocks of every frame; a frame reaches from 0 to its largest z, y and x.  Missing values are 0, voxels without a place are left out."""
    own = frame(voxels)
    shape = voxels.groupBy(*own).agg(*((F.max(a) + 1).cast("int").alias(n) for a, n in zip(AXES, SHAPE)))
    every = shape.filter("nz > 0 AND ny > 0 AND nx > 0").withColumn("_frame", frame_name(voxels))  # no voxels and no frame columns: one row of nulls
    for n, b in zip(SHAPE, PLACE):
        every = every.withColumn(b, F.explode(F.sequence(F.lit(0), F.floor((F.col(n) - 1) / edge).cast("int"))))
    place = [F.floor(F.col(a) / edge).cast("int").alias(b) for a, b in zip(AXES, PLACE)]
    value = F.nanvl(F.coalesce(F.col("value").cast("double"), F.lit(0.0)), F.lit(0.0))
    held = voxels.filter(" AND ".join(f"{a} >= 0" for a in AXES)).select(frame_name(voxels).alias("_frame"), *place, *(F.col(a).cast("int").alias(a) for a in AXES), value.alias("value"))

    def fill(_, one: pd.DataFrame, inside: pd.DataFrame) -> pd.DataFrame:
        if one.empty:
            return one.assign(data=[])
        row = one.iloc[0]
        a = np.zeros([size(row, i, edge) for i in range(3)])
        a[tuple(inside[x].to_numpy() - int(row[b]) * edge for x, b in zip(AXES, PLACE))] = inside.value
        return one.assign(data=[a.tobytes()])

    out = [*own, "_frame", *SHAPE, *PLACE]
    return dealt(every.select(*out), KEY).groupBy(*KEY).cogroup(dealt(held, KEY).groupBy(*KEY)).applyInPandas(fill, schema(every, out, "data binary"))


def along(df: DataFrame, axis: int, step: Callable[[np.ndarray, pd.Series], np.ndarray], edge: int = EDGE) -> DataFrame:
    """``step`` on the blocks of every line along an axis, joined to one array (channel, z, y, x); it also gets the line's first row."""
    key = [k for k in KEY if k != PLACE[axis]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(PLACE[axis])
        out = step(np.concatenate([values(r, edge) for _, r in pdf.iterrows()], axis + 1), pdf.iloc[0])
        cuts = np.split(out, range(edge, out.shape[axis + 1], edge), axis + 1)
        return pdf.assign(data=[np.ascontiguousarray(c, "<f8").tobytes() for c in cuts])

    return dealt(df, key).groupBy(*key).applyInPandas(run, df.schema)


def of_blocks(df: DataFrame, columns: list[str], function: Callable[[np.ndarray, pd.Series], dict], more: str, edge: int = EDGE) -> DataFrame:
    """A few rows a block: its ``columns`` and what ``function`` finds in its array, lists of equal length by name."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                found = pd.DataFrame(function(values(row, edge), row))
                for c in columns:
                    found[c] = row[c]
                yield found[[*columns, *(c for c in found.columns if c not in columns)]]

    return df.mapInPandas(run, schema(df, columns, more))


def voxels_of(df: DataFrame, channels: list[tuple[int, str]], edge: int = EDGE) -> DataFrame:
    """A row a voxel with the named channels as doubles."""
    own = frame(df)

    def run(a: np.ndarray, row: pd.Series) -> dict:
        at = np.indices(a.shape[1:], dtype="int32").reshape(3, -1)
        return {x: p + int(row[b]) * edge for x, p, b in zip(AXES, at, PLACE)} | {name: a[i].ravel() for i, name in channels}

    return of_blocks(df, own, run, ", ".join([*(f"{a} int" for a in AXES), *(f"{name} double" for _, name in channels)]), edge)


def nearest(d: np.ndarray, axis: int, unit: float) -> np.ndarray:
    """Least of d + (distance along the axis)^2; stops at distances that can improve nothing."""
    rows = np.moveaxis(d, axis, 0).copy()
    live = rows.min(0) < FAR  # the other lines have nothing to offer
    given = rows[:, live]
    best = given.copy()
    for k in range(1, len(rows)):
        if not best.size or (k * unit) ** 2 >= best.max():
            break
        best[k:] = np.minimum(best[k:], given[:-k] + (k * unit) ** 2)
        best[:-k] = np.minimum(best[:-k], given[k:] + (k * unit) ** 2)
    rows[:, live] = best
    return np.moveaxis(rows, 0, axis)


def widest(a: np.ndarray, axis: int, r: int) -> np.ndarray:
    """Maximum of a window of 2 r + 1 along an axis."""
    rows = np.moveaxis(a, axis, 0)
    best = rows.copy()
    for k in range(1, min(r, len(rows) - 1) + 1):
        best[k:] = np.maximum(best[k:], rows[:-k])
        best[:-k] = np.maximum(best[:-k], rows[k:])
    return np.moveaxis(best, 0, axis)


def inner(padded: np.ndarray) -> np.ndarray:
    return padded[1:-1, 1:-1, 1:-1]


def beside(padded: np.ndarray) -> Iterator[np.ndarray]:
    """The six neighbours of every inner voxel of a padded array."""
    for axis in range(3):
        for low in (0, 2):
            at = [slice(1, -1)] * 3
            at[axis] = slice(low, padded.shape[axis] - 2 + low)
            yield padded[tuple(at)]


def parts_of(mask: np.ndarray) -> np.ndarray:
    """Parts of a mask over the six neighbours, each named by its first voxel's place in the array (-1 outside)."""
    name = np.full([n + 2 for n in mask.shape], NONE, np.int64)
    inner(name)[mask] = np.flatnonzero(mask)
    while True:
        low = inner(name)
        for near in beside(name):
            low = np.minimum(low, near)
        low = np.where(mask, low, NONE)
        if (low == inner(name)).all():
            return np.where(mask, low, -1)
        inner(name)[:] = low


def lines(row: pd.Series, a: np.ndarray, edge: int) -> np.ndarray:
    """Every voxel's place in its whole volume, as one number."""
    z, y, x = (p + int(row[b]) * edge for p, b in zip(np.indices(a.shape[1:]), PLACE))
    return (z * int(row["ny"]) + y) * int(row["nx"]) + x


def parts(df: DataFrame, channel: int, edge: int = EDGE) -> DataFrame:
    """key of a block, part, label of the parts of a channel's positive voxels.

    ``part`` is the first voxel of what hangs together inside the block;
    ``label`` counts from 1 in a frame by the first voxel of what hangs
    together over all blocks.
    """

    def ends(a: np.ndarray, row: pd.Series) -> dict:
        """Each part of the block, and its voxels on faces: ``face`` is the voxel on the upper side of the seam."""
        mask, line = a[channel] > 0, lines(row, a, edge)
        inside = parts_of(mask)
        part = np.where(mask, line.ravel()[np.maximum(inside, 0)], -1)
        found = [(int(p), None, None) for p in np.unique(part[mask])]
        ahead = (int(row["ny"]) * int(row["nx"]), int(row["nx"]), 1)
        for axis in range(3):
            for side, at in ((0, 0), (1, -1)):
                if not 0 <= (int(row[PLACE[axis]]) + 2 * side - 1) * edge < int(row[SHAPE[axis]]):
                    continue  # the volume ends here
                p, v = (np.take(m, at, axis).ravel() for m in (part, line))
                found += [(int(q), int(w) + side * ahead[axis], 2 * axis + side) for q, w in zip(p, v) if q >= 0]
        return dict(zip(("part", "face", "side"), (pd.array(c, "Int64") for c in zip(*found)))) if found else {"part": [], "face": [], "side": []}

    seen = stored(of_blocks(df, list(KEY), ends, "part bigint, face bigint, side bigint", edge), "parts")
    face = seen.filter("face IS NOT NULL").select(F.col("_frame").alias("dataset"), "part", "face", F.expr("side div 2").alias("axis"), F.expr("side % 2").alias("upper"))
    seams = face.filter("upper = 1").select("dataset", "face", "axis", F.col("part").alias("source")).join(
        face.filter("upper = 0").select("dataset", "face", "axis", F.col("part").alias("target")), ["dataset", "face", "axis"]
    )
    each = seen.filter("face IS NULL")
    united = components(each.select(F.col("_frame").alias("dataset"), F.col("part").alias("node_id")), seams.select("dataset", "source", "target"))
    firsts = placed(united.filter("node_id = component").select("dataset", "component"), ["dataset", "component"], "part-labels")
    start = firsts.groupBy("dataset").agg(F.min("_at").alias("_first"))
    label = firsts.join(start, "dataset").select("dataset", "component", (F.col("_at") - F.col("_first") + 1).alias("label"))
    known = united.join(label, ["dataset", "component"]).select(F.col("dataset").alias("_frame"), F.col("node_id").alias("part"), "label")
    out = stored(each.join(known, ["_frame", "part"]).select(*KEY, "part", "label"), "block-parts")
    remove(seen, united, firsts)
    return out


def flood_block(height: np.ndarray, mask: np.ndarray, seeds: np.ndarray, halo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, steps, label) of every voxel, given those of the voxels behind each face.

    A voxel's level is the least height from which it can be reached, its
    steps the fewest it lies within that level from where the level begins,
    its label the smallest of the neighbours through which both are met.
    Level and steps make one number, so a neighbour reaches a voxel at
    ``max(its number, the voxel's height) + 1``.
    """
    ranks = np.unique(np.concatenate([height[mask], *(h[0][h[2] > 0] for h in halo.values())]))
    own = np.searchsorted(ranks, np.where(mask, height, ranks[0] if ranks.size else 0.0)).astype(np.int64) << STEP_BITS
    seeded = mask & (seeds > 0)
    code = np.full([n + 2 for n in mask.shape], NONE, np.int64)
    name = np.full(code.shape, NONE, np.int64)
    inner(code)[seeded], inner(name)[seeded] = own[seeded], seeds[seeded]
    for (axis, upper), (level, steps, label) in halo.items():
        at = [slice(1, -1)] * 3
        at[axis] = -1 if upper else 0
        told = label > 0
        code[tuple(at)] = np.where(told, (np.searchsorted(ranks, np.where(told, level, 0.0)).astype(np.int64) << STEP_BITS) + steps, NONE)
        name[tuple(at)] = np.where(told, label, NONE)
    while True:
        near = np.minimum.reduce(list(beside(code)))
        now = np.where(mask & (near < NONE), np.minimum(inner(code), np.maximum(near, own) + 1), inner(code))
        if (now == inner(code)).all():
            break
        inner(code)[:] = now
    ways = [np.maximum(c, own) + 1 == inner(code) for c in beside(code)]
    while True:
        near = np.minimum.reduce([np.where(w, n, NONE) for w, n in zip(ways, beside(name))])
        now = np.where(seeded, seeds, np.where(mask, near, NONE))
        if (now == inner(name)).all():
            break
        inner(name)[:] = now
    code, label = inner(code), np.where(inner(name) < NONE, inner(name), 0)
    level = np.where(label > 0, ranks[np.minimum(code >> STEP_BITS, len(ranks) - 1)] if ranks.size else 0.0, 0.0)
    return level, np.where(label > 0, code & ((1 << STEP_BITS) - 1), 0), label


FACE = "axis int, upper int, level binary, steps binary, label binary"


def flood(df: DataFrame, depth: int, tops: int, seeds: DataFrame, edge: int = EDGE) -> DataFrame:
    """frame, z, y, x, label, value: labels of ``seeds`` (see :func:`parts`) spread over positive ``depth``, deepest first (0: not reached).

    ``tops`` is the channel that ``seeds`` were found in, ``value`` channel 0.
    Rounds end when no face changes, which is when every voxel agrees with
    its neighbours; that state is the only one of its kind.
    """
    own = frame(df)
    named = seeds.groupBy(*KEY).agg(F.collect_list(F.struct("part", "label")).alias("seeds"))  # at most a block's voxels
    ready = stored(df.join(named, list(KEY), "left").withColumn("seeds", F.to_json(F.coalesce("seeds", F.array().cast("array<struct<part:bigint,label:bigint>>")))), "flood")
    said = stored(ready.limit(0).select(*KEY).selectExpr("*", *(f"CAST(NULL AS {t}) AS {c}" for c, t in (f.split() for f in FACE.split(", ")))), "faces")

    def solve(one: pd.DataFrame, faces: pd.DataFrame):
        row = one.iloc[0]
        a = values(row, edge)
        seeded = np.zeros(a.shape[1:], np.int64)
        given = json.loads(row["seeds"])
        if given:
            mask, line = a[tops] > 0, lines(row, a, edge)
            part = line.ravel()[np.maximum(parts_of(mask), 0)]
            found = np.array(sorted((s["part"], s["label"]) for s in given))
            seeded = np.where(mask, found[np.minimum(np.searchsorted(found[:, 0], part), len(found) - 1), 1], 0)
        halo = {}
        for f in faces.itertuples():
            flat = tuple(n for i, n in enumerate(a.shape[1:]) if i != f.axis)
            halo[int(f.axis), int(f.upper)] = tuple(np.frombuffer(b, t).reshape(flat) for b, t in ((f.level, "<f8"), (f.steps, "<i8"), (f.label, "<i8")))
        return row, a, flood_block(-a[depth], a[depth] > 0, seeded, halo)

    def told(_, one: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(one):
            row, _, found = solve(one, faces)
            for axis, (n, b) in enumerate(zip(SHAPE, PLACE)):
                for upper in (0, 1):
                    there = int(row[b]) + (1 if upper else -1)
                    level, steps, label = (np.take(m, -1 if upper else 0, axis) for m in found)
                    if 0 <= there * edge < int(row[n]) and label.any():
                        rows.append((row["_frame"], *(there if p == b else int(row[p]) for p in PLACE), axis, 1 - upper, level.astype("<f8").tobytes(), steps.astype("<i8").tobytes(), label.astype("<i8").tobytes()))
        return pd.DataFrame(rows, columns=[*KEY, *(f.split()[0] for f in FACE.split(", "))])

    def labelled(_, one: pd.DataFrame, faces: pd.DataFrame) -> pd.DataFrame:
        names = [*own, *AXES, "label", "value"]
        if one.empty:
            return pd.DataFrame(columns=names)
        row, a, (_, _, label) = solve(one, faces)
        at = np.indices(label.shape, dtype="int32").reshape(3, -1)
        out = pd.DataFrame({x: p + int(row[b]) * edge for x, p, b in zip(AXES, at, PLACE)} | {"label": label.ravel(), "value": a[0].ravel()})
        for c in own:
            out[c] = row[c]
        return out[names]

    active, spent = ready, []
    while True:
        here = said.join(active.select(*KEY).distinct(), list(KEY), "left_semi") if active is not ready else said
        fresh = stored(dealt(active, KEY).groupBy(*KEY).cogroup(dealt(here, KEY).groupBy(*KEY)).applyInPandas(told, schema(ready, list(KEY), FACE)), "faces")
        changed = stored(fresh.join(said, [*KEY, "axis", "upper", "level", "steps", "label"], "left_anti"), "faces")
        spent += [fresh, changed]
        if changed.isEmpty():
            break
        now = stored(said.join(changed, [*KEY, "axis", "upper"], "left_anti").unionByName(changed), "faces")
        spent.append(said)
        said, active = now, ready.join(changed.select(*KEY).distinct(), list(KEY), "left_semi")
    more = ", ".join([*(f"{a} int" for a in AXES), "label bigint", "value double"])
    out = stored(dealt(ready, KEY).groupBy(*KEY).cogroup(dealt(said, KEY).groupBy(*KEY)).applyInPandas(labelled, schema(ready, own, more)), "labels")
    remove(ready, said, *spent)
    return out

"""Embedding whitening by Chan merging.

Vectors are first put on an integer grid (``floor(GRID * c)``), so that sums
are exact and equal vectors are equal.  The fit list holds every distinct grid
vector once, packed in the narrowest integers that hold it.

1. Each partition of the fit list folds its blocks to (count, exact sums,
   centred scatter); two such parts are merged by Chan's formula
   ``M = Ma + Mb + (na nb / n) d d'`` with ``d`` the difference of the means,
   in a ``treeReduce``.  Means are taken from the exact sums, and a block is
   centred by the whole part of its mean in integers before it becomes
   floating point, so that a large common offset costs no digits.
2. The driver gets one d x d matrix and takes its eigenvectors.
3. A second pass over the fit list whitens it, merges count, mean and scatter
   of the whitened vectors the same way, and compares their covariance with
   the identity.
4. A last pass over the table whitens every row.

What a partition sends, and what the driver holds, is a few d x d matrices (32
KB for 64 dimensions), whatever the number of rows.  A hot vector is folded
before the shuffle of the distinct step.

Defined results
---------------
* null vectors, or vectors with null or non-finite entries: no rows, no part.
* vectors of several lengths: each length is a space and a fit list of its own.
* empty vectors: they have no component, so no rows.
* entries beyond the range of a long: the ends of that range.
* repeated rows and null ids: a row each; they count once in the fit list.
* no variance along a component (one vector, constant or dependent
  dimensions): ``whitened`` is null there, and the identity is checked over the
  other components only (``identity_error`` null if there is none).
* a deviation beyond the range of a long: null.
* empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.tables import discard, map_text, materialize
from cladeframe.llm.textnum import claim

#: Grid steps a unit.
GRID = 256
COMPONENTS = 4
#: Entries of a block that is centred and multiplied at once.
BLOCK_ENTRIES = 1 << 19
#: Levels of the tree of merges.
DEPTH = 3
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)


class Part(NamedTuple):
    """Count, sums (exact integers, or floats) and centred scatter of some vectors."""

    n: int
    sums: list
    scatter: np.ndarray


class Whitening(NamedTuple):
    """Fit of the vectors of one length: components by falling eigenvalue, as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    identity_error: float | None


def merge(a: Part, b: Part) -> Part:
    """Chan's pairwise formula; with integer sums the difference of the means is rounded once."""
    n = a.n + b.n
    d = np.array([(y * a.n - x * b.n) / (a.n * b.n) for x, y in zip(a.sums, b.sums)])
    return Part(n, [x + y for x, y in zip(a.sums, b.sums)], a.scatter + b.scatter + np.outer(d, d) * (a.n * b.n / n))


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``x - sums / n`` for integer rows, without losing digits to the size of the mean."""
    whole = [s // n for s in sums]
    rest = np.array([(s - w * n) / n for s, w in zip(sums, whole)])
    if all(_LOW // 4 < int(e) < _HIGH // 4 for e in (x.min(initial=0), x.max(initial=0), *whole)):
        return (x - np.array(whole, np.int64)).astype(np.float64) - rest
    return (x.astype(object) - np.array(whole, object)).astype(np.float64) - rest


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums as integers of any size."""
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(l) for h, l in zip(high.sum(axis=0), low.sum(axis=0))]  # each half stays within a long for 2**31 rows


def block_part(x: np.ndarray) -> Part:
    sums = exact_sums(x)
    c = centred(x, len(x), sums)
    return Part(len(x), sums, c.T @ c)


def grid(c: np.ndarray) -> np.ndarray:
    """floor(GRID * c) as long; beyond the range of a long its ends."""
    y = np.floor(c.astype(np.float64) * GRID)
    out = np.clip(y, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[y >= 2.0**63] = _HIGH
    return out


def finite_vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, grid vectors) of the usable vectors of a list column, by length and in blocks."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    ends = np.cumsum(sizes)
    starts = ends - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = (sizes > 0) & (bad[ends] == bad[starts])
    for d in np.unique(sizes[fine]):
        rows = np.flatnonzero(fine & (sizes == d))
        step = max(1, BLOCK_ENTRIES // int(d))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            with np.errstate(over="ignore"):
                yield some, grid(values[starts[some][:, None] + np.arange(d)])


def _packed(vector: str):
    """(length, bytes) of every usable vector, each in the narrowest integers that hold it."""

    def run(batches):
        claim("whitening")
        for batch in batches:
            for _, x in finite_vectors(batch.column(vector)):
                low, high = x.min(axis=1), x.max(axis=1)
                taken = np.zeros(len(x), bool)
                for kind in _WIDTHS:
                    info = np.iinfo(kind)
                    here = ~taken & (low >= info.min) & (high <= info.max)
                    taken |= here
                    if here.any():
                        raw = x[here].astype(np.dtype(kind).newbyteorder("<"))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(raw), x.shape[1]), pa.int32()), pa.array([r.tobytes() for r in raw], pa.binary())], names=["d", "packed"]
                        )

    return run


def fit_list(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """(d, packed): every distinct grid vector once."""
    return map_text(table.select(vector), _packed(vector), "d int, packed binary").distinct()


def _unpacked(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The grid vectors of a batch of the fit list, by length and width, in blocks."""
    d = batch.column("d").to_numpy(zero_copy_only=False)
    packed = batch.column("packed")
    sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False)
    for length, size in np.unique(np.stack([d, sizes], axis=1), axis=0):
        kind = np.dtype(f"<i{size // length}")
        rows = np.flatnonzero((d == length) & (sizes == size))
        step = max(1, BLOCK_ENTRIES // int(length))
        for at in range(0, len(rows), step):
            some = packed.take(pa.array(rows[at : at + step])).to_pylist()
            yield np.frombuffer(b"".join(some), kind).reshape(-1, length).astype(np.int64)


def _exact_parts(batches):
    """One row a length: count, exact sums and scatter of the partition's vectors."""
    claim("whitening")
    held: dict[int, Part] = {}
    for batch in batches:
        for x in _unpacked(batch):
            part, d = block_part(x), x.shape[1]
            held[d] = merge(held[d], part) if d in held else part
    if held:
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(held), pa.int32()), pa.array([p.n for p in held.values()], pa.int64()),
                pa.array([[Decimal(s) for s in p.sums] for p in held.values()], pa.list_(pa.decimal128(38, 0))),
                pa.array([p.scatter.tobytes() for p in held.values()], pa.binary()),
            ],
            names=["d", "n", "sums", "scatter"],
        )


def whitened(x: np.ndarray, fit: Whitening, k: int) -> np.ndarray:
    """Projections on the first k components over the square root of their eigenvalues; NaN where there is no variance."""
    k = min(k, len(fit.values))
    scale = np.full(k, np.nan)
    some = fit.values[:k] > 0
    scale[some] = 1 / np.sqrt(fit.values[:k][some])
    return centred(x, fit.n, fit.sums) @ fit.vectors[:, :k] * scale


def _check_parts(fits: dict[int, Whitening], k: int):
    """One row a length: count, sums and scatter of the partition's whitened vectors."""

    def run(batches):
        claim("whitening")
        held: dict[int, Part] = {}
        for batch in batches:
            for x in _unpacked(batch):
                d = x.shape[1]
                w = whitened(x, fits[d], k)[:, fits[d].values[:k] > 0]
                sums = w.sum(axis=0)
                c = w - sums / len(w)
                part = Part(len(w), sums.tolist(), c.T @ c)
                held[d] = merge(held[d], part) if d in held else part
        if held:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(held), pa.int32()), pa.array([p.n for p in held.values()], pa.int64()),
                    pa.array([p.sums for p in held.values()], pa.list_(pa.float64())), pa.array([p.scatter.tobytes() for p in held.values()], pa.binary()),
                ],
                names=["d", "n", "sums", "scatter"],
            )

    return run


def _by_length(row) -> dict[int, Part]:
    sums = [int(s) if isinstance(s, Decimal) else s for s in row["sums"]]
    return {row["d"]: Part(row["n"], sums, np.frombuffer(bytes(row["scatter"])).reshape(len(sums), len(sums)))}


def _merge_lengths(a: dict[int, Part], b: dict[int, Part]) -> dict[int, Part]:
    return a | {d: merge(a[d], p) if d in a else p for d, p in b.items()}


def _reduced(parts: DataFrame) -> dict[int, Part]:
    """The parts of all partitions merged by length in a tree."""
    none: dict[int, Part] = {}
    return parts.rdd.map(_by_length).treeAggregate(none, _merge_lengths, _merge_lengths, DEPTH)


def components(part: Part) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit eigenvectors as columns, the largest entry of each positive.

    Eigenvalues within rounding of zero are zero.
    """
    values, vectors = np.linalg.eigh(part.scatter / part.n)
    values, vectors = values[::-1].copy(), vectors[:, ::-1]
    values[values <= values.max(initial=0) * len(values) * np.finfo(float).eps * 8] = 0.0
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * sign


def fit(table: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of every vector length; ``identity_error`` is that of the first k components over the fit list."""
    distinct = materialize(fit_list(table, vector), "whitening-fit")
    parts = _reduced(map_text(distinct, _exact_parts, "d int, n bigint, sums array<decimal(38,0)>, scatter binary"))
    fits = {d: Whitening(p.n, p.sums, *components(p), None) for d, p in parts.items()}
    checked = _reduced(map_text(distinct, _check_parts(fits, k), "d int, n bigint, sums array<double>, scatter binary")) if fits else {}
    discard(distinct)
    errors = {d: np.abs(p.scatter / p.n - np.eye(len(p.sums))).max() for d, p in checked.items() if p.sums}
    return {d: f._replace(identity_error=float(errors[d]) if d in errors else None) for d, f in fits.items()}


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - sums)^2, exactly; None beyond the range of a long."""
    most = max(max(abs(int(x.min())), abs(int(x.max()))) * n, 0) + max(map(abs, sums))
    if most * most * x.shape[1] <= _HIGH:
        e = x * n - np.array(sums, np.int64)
        return (e * e).sum(axis=1).tolist()
    e = x.astype(object) * n - np.array(sums, object)
    return [v if v <= _HIGH else None for v in (int(v) for v in (e * e).sum(axis=1))]


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """key, n, deviation, whitened, explained (arrays of up to k components), identity_error of every usable row."""
    fits = fit(table, vector, k)

    def run(batches):
        claim("whitening")
        for batch in batches:
            for rows, x in finite_vectors(batch.column(vector)):
                f = fits[x.shape[1]]
                m, w = len(rows), whitened(x, f, k)
                trace = f.values.sum()
                explained = (f.values[: w.shape[1]] / trace).tolist() if trace > 0 else [None] * w.shape[1]
                flat = pa.array(w.ravel(), pa.float64(), from_pandas=True)  # NaN becomes null
                at = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(key).take(pa.array(rows)), pa.array(np.full(m, f.n), pa.int64()), pa.array(deviations(x, f.n, f.sums), pa.int64()),
                        pa.ListArray.from_arrays(at, flat), pa.array([explained] * m, pa.list_(pa.float64())), pa.array([f.identity_error] * m, pa.float64()),
                    ],
                    names=[key, "n", "deviation", "whitened", "explained", "identity_error"],
                )

    kind = table.schema[key].dataType.simpleString()
    return map_text(table.select(key, vector), run, f"`{key}` {kind}, n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double")


def by_component(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """A row for each row and component (from 1) of :func:`whiten`'s result."""
    each = rows.select(key, "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "it"))
    return each.select(key, (F.col("at") + 1).alias("component"), "n", "deviation", F.col("it.whitened").alias("whitened"), F.col("it.explained").alias("explained"), "identity_error")

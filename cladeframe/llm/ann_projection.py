"""Nearest neighbours by low-dimensional stable projections and kd-trees.

Vectors are projected to ``DIMS`` Gaussian (2-stable) directions: the squared
projected distance of two vectors is their squared distance times a chi-square
variable of ``DIMS`` degrees.  So once ``k`` neighbours within distance ``d``
are known, whatever lies farther than ``d * sqrt(q)`` in the projection, q
being the chi-square quantile of ``CONFIDENCE``, is nearer than ``d`` with
probability at most ``1 - CONFIDENCE``; the search stops there.  A neighbour is
therefore missed with at most that probability, on any data; what share of the
rows is verified depends on the data and is reported for every query.

The projected space is cut by a kd-tree whose split values are fitted on a
bounded sample (``SAMPLE_ROWS``, at least ``CELL_SAMPLE`` of them a cell); every
row is assigned to a leaf, the *cell*.  Cells are split further by a hash into
blocks of about ``BLOCK_ROWS`` rows, so no cell, however many rows or equal
vectors it holds, comes to one task.

1. Every query searches one block of its own cell: a first bound ``d``.
2. The stopping test against the cells' bounding boxes leaves the cells that
   the query must visit; it is sent to all their blocks but the first.  Routes
   are ids; vectors are joined to them on the way to the search.
3. In a block, a kd-tree over the distinct projected points gives its leaves in
   the order of projected distance.  Of a leaf, the points within the present
   radius are verified in full (double precision), nearest projections first,
   until the stopping test holds for the rest.
4. The best ``k`` of the blocks are merged by (distance, id).

Equal vectors are verified once and carry their smallest ids, as many as a
result can use.

Defined results
---------------
* vectors null, empty, zero, or with null or non-finite components, and rows
  with a null id, take no part; neither do those of another length than the
  most common one.
* fewer than ``k`` candidates: all of them.  Repeated ids: each row is a
  candidate; rows with the query's own id are not; a repeated query id is
  answered once, for its smallest vector.
* empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.tables import discard, materialize, maybe_broadcast, stable_sample

K = 10
DIMS = 24
CONFIDENCE = 0.95
SAMPLE_ROWS = 32_768
CELL_SAMPLE = 8
CELL_ROWS = 16_000
BLOCK_ROWS = 16_000
QUERY_ROWS = 8_000
LEAF_ROWS = 256
#: Points verified together before the radius is taken anew.
STRIDE = 64


def chi_square_quantile(p: float, dims: int) -> float:
    """Value below which a chi-square variable of ``dims`` degrees lies with probability p."""
    def below(x: float) -> float:  # regularised lower gamma function by its series
        a, z = dims / 2, x / 2
        term = total = 1 / a
        n = a
        while term > 1e-15 * total:
            n += 1
            term *= z / n
            total += term
        return total * math.exp(-z + a * math.log(z) - math.lgamma(a))

    lo, hi = 1e-9, 200.0 + 10 * dims
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def directions(length: int, dims: int = DIMS, seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dims))


def rounding(length: int, norm: float, longest: float) -> float:
    """Bound of how far apart two projections of one vector may lie; equal vectors of different batches can differ in their last bits.

    ``longest``: the root of the summed squares of the directions.
    """
    return 4 * length * np.finfo(float).eps * norm * longest


def within(limit: float, stop: float, room: float) -> float:
    """Squared projected distance up to which the stopping test goes on."""
    return (math.sqrt(stop * limit) + room) ** 2


class KdTree:
    """Median splits of points; leaves have bounding boxes and row numbers."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.leaves: list[np.ndarray] = []
        low, high = [], []
        todo = [np.arange(len(points))] if len(points) else []
        while todo:
            rows = todo.pop()
            part = points[rows]
            a, b = part.min(0), part.max(0)
            if len(rows) <= leaf_rows or not (b > a).any():
                self.leaves.append(rows)
                low.append(a)
                high.append(b)
                continue
            half = len(rows) // 2
            order = np.argpartition(part[:, int((b - a).argmax())], half)
            todo += [rows[order[:half]], rows[order[half:]]]
        self.low, self.high = np.array(low), np.array(high)

    def gaps(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to every leaf's box."""
        gap = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        return (gap * gap).sum(1)


class Block:
    """The distinct vectors of a block with their smallest ids, and a kd-tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, project: np.ndarray, k: int = K):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        raw = vectors.view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        self.vectors = vectors[first]
        by_vector = np.argsort(which, kind="stable")  # ids stay in order
        starts = np.searchsorted(which[by_vector], np.arange(len(first)))
        ends = np.append(starts[1:], len(ids))
        # an id at most k times, so that 2 k ids are enough whichever of them a query leaves out as its own
        place = np.arange(len(ids))
        head = np.append(True, (np.diff(which[by_vector]) != 0) | (np.diff(ids[by_vector]) != 0))[: len(ids)]
        few = place - np.maximum.accumulate(np.where(head, place, 0)) < k
        self.ids = [ids[by_vector[a:b][few[a:b]][: 2 * k]] for a, b in zip(starts, ends)]
        self.longest = float(np.linalg.norm(project))
        self.points = self.vectors @ project
        self.tree = KdTree(self.points, LEAF_ROWS)

    def search(self, own: int, vector: np.ndarray, point: np.ndarray, bound: float, stop: float, k: int = K) -> tuple[list[tuple[float, int]], int]:
        """The k nearest (squared distance, id), and how many vectors were verified; ``bound``: squared distance within which k are known already."""
        far, near, rows_of = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the candidates that may be among the k
        gaps = self.tree.gaps(point)
        room, seen = rounding(len(vector), float(np.linalg.norm(vector)), self.longest), 0
        limit = bound
        for leaf in np.argsort(gaps, kind="stable"):
            if gaps[leaf] > within(limit, stop, room):
                break
            rows = self.tree.leaves[leaf]
            apart = self.points[rows] - point
            gap = np.einsum("ij,ij->i", apart, apart)
            order = np.argsort(gap, kind="stable")
            rows, gap = rows[order], gap[order]
            at = 0
            while at < len(rows) and gap[at] <= within(limit, stop, room):
                some = rows[at : at + STRIDE][gap[at : at + STRIDE] <= within(limit, stop, room)]
                at += STRIDE
                seen += len(some)
                apart = self.vectors[some] - vector
                d = np.einsum("ij,ij->i", apart, apart)
                fits = d <= limit
                if fits.any():
                    new = some[fits]
                    far, near = np.concatenate([far, d[fits]]), np.concatenate([near, new])
                    rows_of = np.concatenate([rows_of, [int((self.ids[i] != own).sum()) for i in new]])
                    order = np.argsort(far, kind="stable")
                    far, near, rows_of = far[order], near[order], rows_of[order]
                    full = int(np.searchsorted(np.cumsum(rows_of), k))
                    if full < len(far):
                        limit = min(limit, float(far[full]))
                        keep = far <= limit  # all that tie with the last
                        far, near, rows_of = far[keep], near[keep], rows_of[keep]
        best = sorted((float(d), int(x)) for d, i in zip(far, near) for x in self.ids[i] if x != own)
        return best[:k], seen


class Cells:
    """kd-tree cells of the projected space, fitted on a sample."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.splits: list[tuple[int, float] | None] = [None] * (2**depth)
        self.depth = depth

        def cut(node: int, rows: np.ndarray) -> None:
            if node >= 2**depth:
                return
            axis, value = 0, 0.0
            if len(rows):
                axis = int(np.ptp(rows, axis=0).argmax())
                value = float(np.median(rows[:, axis]))
            self.splits[node] = (axis, value)
            cut(2 * node, rows[rows[:, axis] <= value] if len(rows) else rows)
            cut(2 * node + 1, rows[rows[:, axis] > value] if len(rows) else rows)

        cut(1, sample)
        self.axes = np.array([0] + [s[0] for s in self.splits[1:]], np.int64)
        self.values = np.array([0.0] + [s[1] for s in self.splits[1:]])

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axes[node]] > self.values[node])
        return node


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).filter(
        F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", fine) & F.exists("embedding", lambda x: x != 0)
    )
    common = ok.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return ok.filter(F.size("embedding") == (common["n"] if common else 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = K, dims: int = DIMS, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score and the vectors verified for the query: the k nearest found of every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double, verified long"
    rows = usable(vectors)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema)
    length = len(rows.first()["embedding"])
    held = stable_sample(rows, "vec_id", SAMPLE_ROWS, n).select("embedding").toArrow().column("embedding").combine_chunks()  # about SAMPLE_ROWS rows
    sample = held.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
    project = directions(length, dims)
    stop = chi_square_quantile(confidence, dims)
    depth = max(0, math.ceil(math.log2(max(1, min(n / CELL_ROWS, len(sample) / CELL_SAMPLE)))))
    cells = Cells(sample @ project if len(sample) else np.zeros((0, dims)), depth)
    tools = spark.sparkContext.broadcast((project, cells))  # fixed size: dims by length, a split for CELL_SAMPLE rows of the sample

    def place(batches):
        p, c = tools.value
        for pdf in batches:
            if not len(pdf):
                continue
            points = np.stack(pdf["embedding"].to_numpy()) @ p
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "embedding": pdf["embedding"], "cell": c.of(points), "point": list(points)})

    placed = materialize(rows.mapInPandas(place, "vec_id long, embedding array<double>, cell long, point array<double>"), "ann-placed")
    box = [f(F.col("point")[i]).alias(f"{f.__name__}{i}") for i in range(dims) for f in (F.min, F.max)]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *box).collect()  # a row for CELL_SAMPLE rows of the sample
    blocks = {r["cell"]: max(1, math.ceil(r["n"] / BLOCK_ROWS)) for r in boxes}
    sizes = spark.createDataFrame([(c, b) for c, b in blocks.items()], "cell long, blocks int")
    salted = placed.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    asked = placed.filter(F.col("vec_id") % every == 0)
    asked = asked.groupBy("vec_id").agg(F.min(F.struct("embedding", "point", "cell")).alias("q")).select(
        F.col("vec_id").alias("query_id"), "q.embedding", "q.point", "q.cell"
    )
    asked = materialize(asked, "ann-asked")
    n_asked = asked.count()
    parts = max(1, math.ceil(n_asked / QUERY_ROWS))
    found_schema = "query_id long, vec_id long, far double, verified long"

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            p, _ = tools.value
            block = Block(right["vec_id"].to_numpy(), np.stack(right["embedding"].to_numpy()), p, k)
            for own, vector, point, bound in zip(left["query_id"], left["embedding"], left["point"], left["bound"]):
                best, seen = block.search(own, vector, point, bound, stop, k)
                out += [(own, None, None, seen), *((own, x, d, 0) for d, x in best)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "far", "verified"]).astype({"query_id": "int64", "vec_id": "Int64", "far": "float64", "verified": "int64"})

    def visit(queries: DataFrame) -> DataFrame:
        """Search the block that each row (query_id, bound, cell, block) names; queries come in parts, so no group outgrows a task."""
        split = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
        wanted = split.select("cell", "block", "part").distinct()
        held = salted.join(maybe_broadcast(wanted, wanted.count(), 24), ["cell", "block"]).select(
            "vec_id", "embedding", "cell", "block", (F.col("part") + 0).alias("part")
        )
        key = ["cell", "block", "part"]
        vectors = asked.select("query_id", "embedding", "point")
        told = split.join(maybe_broadcast(vectors, n_asked, 8 * (length + dims + 4)), "query_id")
        return told.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(search, found_schema)

    home = asked.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    home = home.select("query_id", "point", "cell", "block", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)).alias("norm"))
    first = materialize(visit(home.select("query_id", F.lit(float("inf")).alias("bound"), "cell", "block")), "ann-first")
    bounds = first.filter("vec_id is not null").groupBy("query_id").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("k"))
    bounded = home.join(bounds, "query_id", "left").withColumn("bound", F.when(F.col("k") >= k, F.col("far")).otherwise(F.lit(float("inf"))))
    lows = np.array([[r[f"min{i}"] for i in range(dims)] for r in boxes])
    highs = np.array([[r[f"max{i}"] for i in range(dims)] for r in boxes])
    names = np.array([r["cell"] for r in boxes])
    boxed = spark.sparkContext.broadcast((names, lows, highs, blocks))  # a row for CELL_SAMPLE rows of the sample

    def route(batches):
        cell_names, low, high, count = boxed.value
        longest = float(np.linalg.norm(tools.value[0]))
        for pdf in batches:
            out = []
            for own, point, norm, bound, cell, block in zip(*(pdf[c] for c in ("query_id", "point", "norm", "bound", "cell", "block"))):
                gap = np.maximum(low - point, 0) + np.maximum(point - high, 0)
                for c in cell_names[(gap * gap).sum(1) <= within(bound, stop, rounding(length, norm, longest))]:
                    out += [(own, bound, c, b) for b in range(count[c]) if (c, b) != (cell, block)]
            if out:
                yield pd.DataFrame(out, columns=["query_id", "bound", "cell", "block"])

    routed = materialize(bounded.mapInPandas(route, "query_id long, bound double, cell long, block int"), "ann-routed")
    rest = materialize(visit(routed), "ann-rest")
    every_one = first.union(rest)
    work = every_one.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    top = (
        every_one.filter("vec_id is not null").groupBy("query_id")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id"))), 1, k).alias("top"))  # k rows a visited block
        .join(work, "query_id")
        .select("query_id", "verified", F.posexplode("top").alias("at", "x"))
        .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.sqrt("x.far").alias("score"), "verified")
    )
    top = materialize(top, "ann-top")
    discard(placed, asked, first, routed, rest)
    return top

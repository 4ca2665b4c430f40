"""SimHash near-duplicates by vantage-point trees over the fingerprints.

A document's fingerprint has bit i set if more than half of its word shingles
(repeats included) have bit i set in their XXH64 hash.  Two fingerprints link
if they differ in at most ``RADIUS`` bits.  Documents are folded to distinct
fingerprints first, so that copies never meet each other.

1. A vantage-point tree is grown on a sample of ``LEAF_SAMPLE`` fingerprints a
   leaf: a node has a vantage point ``v`` and a bound ``r``.  By the triangle
   inequality two fingerprints whose distances to ``v`` differ by more than
   RADIUS never link.  So a fingerprint goes to the near branch if its distance
   is at most ``r + RADIUS`` and to the far branch if it is above ``r``: a
   linked pair is whole in one branch at least, and only fingerprints in the
   shell between the bounds are sent to both.
2. Every fingerprint is routed to the leaves that it can have partners in.  A
   leaf is a shard, which one task searches: it goes on splitting by vantage
   points of its own until a node is small or no vantage point divides it, and
   compares what is left in blocks.  A shard returns not its pairs but, for
   every fingerprint that has a partner, one that is connected to it.
3. A shard of more than ``SHARD_ROWS`` fingerprints (many of them so close that
   no vantage point of the tree divides them) is cut into parts by a hash, and
   a task gets two parts: all pairs are still met.
4. The shards' links are contracted to components.

Nothing is dropped or capped: the bounds only decide how work is cut.  The
driver gets the sample and one row a shard, never all fingerprints.

Defined results
---------------
* null or empty text, or no words: fingerprint zero, linked like any other.
* fewer than three words: the whole sequence is the one shingle.
* repeated rows and rows that share a ``doc_id``: a row each, by their texts.
* null ``doc_id``: linked like others; a component is named by its smallest id
  that is not null (null if there is none).
* empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cladeframe.llm.components import connected_components
from cladeframe.llm.tables import discard, fewer, map_text, materialize, maybe_broadcast, stable_sample
from cladeframe.llm.textnum import blocks, claim, lower_ascii, words

WIDTH = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a shard that the tree aims at, of the sample a leaf, and levels of the tree at most.
SHARD_AIM = 2_048
LEAF_SAMPLE = 64
MAX_LEVELS = 14
#: Fingerprints of one task at most; larger shards are met in pairs of parts.
SHARD_ROWS = 4_000_000
#: Fingerprints that a task compares directly, and rows of one comparison.
SMALL = 192
#: Hashes that are made, and whose bits are spread, at once.
SLICE = 1 << 14
STRIPE = 256
#: Vantage points tried for a node, and fingerprints they are tried on.
TRIES = 6
TRIAL = 256
#: Links that a task holds before it contracts them.
HELD_LINKS = 1 << 20
#: A fingerprint of more than this share of all rows is joined by broadcast; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001


def fingerprint(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The majority bits of each run ``hashes[start:end]`` of 64-bit hashes; zero for an empty run."""
    out = np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(ends > starts)
    if not len(some):
        return out
    counts = np.zeros((len(some), 64), np.int64)
    owner = np.repeat(np.arange(len(some)), (ends - starts)[some])
    flat = hashes[starts[some][0] : ends[some][-1]]
    for at in range(0, len(flat), SLICE):
        part = flat[at : at + SLICE].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        own = owner[at : at + SLICE]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    set_bits = 2 * counts > (ends - starts)[some][:, None]
    out[some] = np.packbits(set_bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words one space apart; words of two documents may touch."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    inner = ends < len(data)
    parted = np.zeros(len(ends), bool)
    parted[inner] = space[ends[inner]]
    flat = data.copy()
    flat[space] = 32
    keep = ~space
    keep[ends[parted]] = True
    sizes = ends - starts
    at = np.cumsum(sizes + parted) - sizes - parted
    return flat[keep], at, at + sizes


def text_fingerprints(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of every document of a block."""
    low = lower_ascii(data)
    starts, ends, doc = words(low, offs)
    flat, starts, ends = spaced(low, starts, ends)
    n_docs = len(offs) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    n = np.diff(first)
    shingles = np.where(n == 0, 0, np.maximum(n - width + 1, 1))
    at = np.concatenate([[0], np.cumsum(shingles)])
    head = np.repeat(first[:-1] - at[:-1], shingles) + np.arange(at[-1])
    tail = head + np.repeat(np.minimum(n, width), shingles) - 1
    view, digest = memoryview(flat.tobytes()), xxhash.xxh64_intdigest
    hashes = np.zeros(len(head), np.uint64)
    for i in range(0, len(head), SLICE):
        part = slice(i, i + SLICE)
        spans = zip(starts[head[part]].tolist(), ends[tail[part]].tolist())
        hashes[part] = np.fromiter((digest(view[a:b], SEED) for a, b in spans), np.uint64)
    return fingerprint(hashes, at[:-1], at[1:])


def _fingerprints(width: int):
    def run(batches):
        claim("simhash")
        for batch in batches:
            found = [text_fingerprints(data, offs, width) for _, _, data, offs in blocks(batch.column("text"))]
            bits = np.concatenate([*found, np.zeros(0, np.uint64)]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(bits, pa.int64())], names=["doc_id", "bits"])

    return run


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, bits (the fingerprint as a signed 64-bit number) of every row."""
    return map_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _fingerprints(width), "doc_id bigint, bits bigint")


def apart(a, b) -> np.ndarray:
    """Hamming distance."""
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def vantage(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """(vantage point, bound) that leaves the least to compare in both branches; None if none divides the points.

    With branches of shares p and q of the points, p^2 + q^2 of the
    comparisons are left.
    """
    seen = points if len(points) <= TRIAL else points[rng.integers(0, len(points), TRIAL)]
    best = None
    for v in points[rng.integers(0, len(points), TRIES)]:
        under = np.cumsum(np.bincount(apart(v, seen), minlength=65 + radius)) / len(seen)
        near = np.concatenate([under[radius:], np.ones(radius)])[: len(under)]  # at most r + radius, by r
        cost = near**2 + (1 - under) ** 2
        r = int(np.argmin(cost))
        if best is None or cost[r] < best[0]:
            best = (cost[r], v, r)
    return None if best is None or best[0] > 0.92 else (best[1], best[2])


def branches(d: np.ndarray, bound: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near and of the far branch, by distance to the vantage point."""
    return np.flatnonzero(d <= bound + radius), np.flatnonzero(d > bound)


def grow(points: np.ndarray, levels: int, radius: int) -> list:
    """The tree as a list of nodes (vantage point, bound, near, far); a leaf is (shard,)."""
    rng = np.random.default_rng(len(points))
    nodes: list = [None]
    open_ = [(0, points, levels)]
    shards = 0
    while open_:
        at, here, left = open_.pop()
        cut = vantage(here, radius, rng) if left and len(here) > LEAF_SAMPLE // 4 else None
        if cut is None:
            nodes[at] = (shards,)
            shards += 1
            continue
        near, far = branches(apart(cut[0], here), cut[1], radius)
        nodes[at] = (cut[0], cut[1], len(nodes), len(nodes) + 1)
        nodes += [None, None]
        open_ += [(nodes[at][2], here[near], left - 1), (nodes[at][3], here[far], left - 1)]
    return nodes


def _routed(nodes: list, radius: int):
    """(shard, bits) for every shard in which a fingerprint can have a partner."""

    def run(batches):
        claim("simhash")
        for batch in batches:
            points = batch.column("bits").to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            open_ = [(0, points)]
            while open_:
                at, here = open_.pop()
                node = nodes[at]
                if len(node) == 1:
                    if len(here):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), node[0]), pa.int32()), pa.array(here.view(np.int64))], names=["shard", "bits"])
                    continue
                near, far = branches(apart(node[0], here), node[1], radius)
                open_ += [(node[2], here[near]), (node[3], here[far])]

    return run


class Links:
    """Components of numbered points, contracted whenever enough links are held."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)
        self._held: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        news = self.label[a] != self.label[b]
        if news.any():
            self._held.append((a[news], b[news]))
            self._n += int(news.sum())
            if self._n >= HELD_LINKS:
                self.contract()

    def contract(self) -> np.ndarray:
        """The smallest number of each point's component."""
        if self._held:
            a, b = (np.concatenate(x) for x in zip(*self._held))
            self._held, self._n = [], 0
            label = self.label
            while True:
                x, y = label[a], label[b]
                open_ = x != y
                if not open_.any():
                    break
                a, b, x, y = a[open_], b[open_], x[open_], y[open_]
                np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = label[label]
                    if np.array_equal(up, label):
                        break
                    label = up
            self.label = label
        return self.label


def linked(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct points the smallest place of a point that it is connected to by links."""
    rng = np.random.default_rng(len(points))
    links = Links(len(points))
    open_ = [np.arange(len(points), dtype=np.int32)]
    while open_:
        at = open_.pop()
        here = points[at]
        cut = vantage(here, radius, rng) if len(at) > SMALL else None
        if cut is not None:
            near, far = branches(apart(cut[0], here), cut[1], radius)
            if max(len(near), len(far)) < len(at):
                open_ += [at[near], at[far]]
                continue
        for i in range(0, len(at), STRIPE):  # each pair once: a stripe against itself and what follows
            a, b = np.nonzero(apart(here[i : i + STRIPE, None], here[None, i:]) <= radius)
            later = a < b
            links.add(at[i + a[later]], at[i + b[later]])
    return links.contract()


def _searched(radius: int):
    """(a, b): a fingerprint of the shard and the one that its component in the shard is named by."""

    def run(table: pa.Table) -> pa.Table:
        claim("simhash")
        points = np.unique(table.column("bits").to_numpy().astype(np.int64)).view(np.uint64)
        label = linked(points, radius)
        bound = np.flatnonzero(label != np.arange(len(points)))
        signed = points.view(np.int64)
        return pa.table({"a": pa.array(signed[bound], pa.int64()), "b": pa.array(signed[label[bound]], pa.int64())})

    return run


def shards(points: DataFrame, n: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """(shard, first, second, bits), the groups that are searched, and the stored table they are read from; ``n`` is the number of points."""
    levels = min(MAX_LEVELS, max(0, math.ceil(math.log2(max(1, n / SHARD_AIM)))))
    nodes: list = [(0,)]
    if levels:
        sample = stable_sample(points.select("bits"), "bits", LEAF_SAMPLE << levels, n)
        nodes = grow(np.sort(sample.toArrow().column("bits").to_numpy()).view(np.uint64), levels, radius)
    routed = materialize(map_text(points.select("bits"), _routed(nodes, radius), "shard int, bits bigint"), "simhash-routed")
    sizes = routed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD_ROWS).collect()  # at most a row a leaf
    whole = routed.select("shard", F.lit(0).alias("first"), F.lit(0).alias("second"), "bits")
    if not sizes:
        return whole, routed
    parts = F.broadcast(points.sparkSession.createDataFrame([(r["shard"], 2 * math.ceil(r["n"] / SHARD_ROWS)) for r in sizes], "shard int, parts int"))
    own = F.pmod(F.xxhash64("bits"), F.col("parts")).cast("int")
    large = routed.join(parts, "shard").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = large.select("shard", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "bits")
    return whole.join(parts, "shard", "left_anti").unionByName(met), routed


def components(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, root) of every fingerprint that has a partner; ``points`` is a stored table of distinct ``bits``."""
    groups, routed = shards(points, points.count(), radius)
    found = groups.groupBy("shard", "first", "second").applyInArrow(_searched(radius), "a bigint, b bigint")
    links = materialize(found.distinct(), "simhash-links")
    discard(routed)
    members = connected_components(links, "a", "b", "simhash", links.count())
    discard(links)
    return members


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, bits, component_id (the smallest id reachable by links) of every row."""
    rows = materialize(fingerprints(docs, width), "simhash-rows")
    total = rows.count()
    points = materialize(fewer(rows.groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low")), total), "simhash-points")
    members = components(points, radius)
    lows = members.join(points, members["node"] == points["bits"]).groupBy("root").agg(F.min("low").alias("component_id"))
    named = members.join(lows, "root").select(F.col("node").alias("bits"), "component_id")
    # a fingerprint of one row without partners keeps the row's own id
    named = points.join(named, "bits", "left").withColumn("component_id", F.coalesce("component_id", "low")).filter("n > 1 or component_id is distinct from low")
    named = materialize(fewer(named.select("bits", "n", "component_id"), total), "simhash-named")
    discard(points, members)
    k = named.count()
    hot = named.filter(F.col("n") > total * HOT_SHARE).select("bits", "component_id")
    cold = named.filter(F.col("n") <= total * HOT_SHARE).select("bits", "component_id")
    held = F.broadcast(hot)  # fewer than 1 / HOT_SHARE rows
    ahead = rows.join(held, "bits").select("doc_id", "bits", "component_id")
    rest = rows.join(held, "bits", "left_anti").join(maybe_broadcast(cold, k), "bits", "left")
    return ahead.unionByName(rest.select("doc_id", "bits", F.when(F.col("component_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def hex_digits(bits) -> F.Column:
    """A 64-bit number as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))

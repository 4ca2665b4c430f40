"""Distance joins of point tables, rewritten as equi-joins on grid cells.

Points meet only within a frame relation (dataset, t + shift) and a cell of
the gate's width: one side is sent to its 27 neighbouring cells, the other
stays where it is, and the exact distance is a filter.  No pair farther than
two cells is ever made, whatever the size of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.schema import distance
from cladeframe.scratch import stored

UNIT = (1.0, 1.0, 1.0)


def _cells(df: DataFrame, gate: float, scale) -> list:
    return [F.floor(F.col(a) * s / gate).cast("bigint").alias(f"_c{a}") for a, s in zip("zyx", scale)]


def radius_join(left: DataFrame, right: DataFrame, gate: float, shift: int = 0, scale=UNIT, keep=(), left_keep=(), right_keep=()) -> DataFrame:
    """Pairs with right.t = left.t + shift and distance <= gate.

    Both sides hold dataset, node_id, t, z, y, x; result: dataset, t (of the
    left side), left_id, right_id, distance, left_/right_ copies of the
    columns in ``keep`` and the columns of one side in ``left_keep`` and
    ``right_keep``.  Pairs stream out of the join, which holds right points
    only: Spark would take the 27 copies for no larger than the left table and
    send them all through the driver.
    """
    cols = list(dict.fromkeys(["dataset", "node_id", "t", "z", "y", "x", *keep]))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = left.select(*cols, *left_keep, *_cells(left, gate, scale))
    for axis in "zyx":
        a = a.withColumn("_d", F.explode(near)).withColumn(f"_c{axis}", F.col(f"_c{axis}") + F.col("_d")).drop("_d")
    b = right.select(*cols, *right_keep, *_cells(right, gate, scale)).withColumn("_t", F.col("t") - shift)
    a, b = a.alias("a"), b.alias("b").hint("shuffle_hash")
    same = (F.col("a.dataset") == F.col("b.dataset")) & (F.col("a.t") == F.col("b._t"))
    for axis in "zyx":
        same &= F.col(f"a._c{axis}") == F.col(f"b._c{axis}")
    d = distance("a", "b", scale)
    extra = [F.col(f"{s}.{c}").alias(f"{n}_{c}") for c in keep for s, n in (("a", "left"), ("b", "right"))]
    extra += [F.col(f"{s}.{c}").alias(c) for s, some in (("a", left_keep), ("b", right_keep)) for c in some]
    return a.join(b, same & (d <= gate)).select(
        F.col("a.dataset").alias("dataset"), F.col("a.t").alias("t"), F.col("a.node_id").alias("left_id"), F.col("b.node_id").alias("right_id"), d.alias("distance"), *extra
    )


#: Pairs of points in one cell that a search may meet at once, whatever the number of points.
FEW_PAIRS = 1_000_000
#: How often a search may halve its gate for a start.
HALVINGS = 8


def _first_gate(left: DataFrame, right: DataFrame, k: int, gate: float, shift: int, scale, few: int | None = None) -> float:
    """The widest of gate, gate / 2, ... at which points share cells with about ``k`` others, by counts of all cells at every width."""
    level = F.explode(F.sequence(F.lit(0), F.lit(HALVINGS)))
    cells = [F.floor(F.col(a) * s / gate * F.pow(F.lit(2.0), F.col("_level"))).cast("bigint").alias(f"_c{a}") for a, s in zip("zyx", scale)]
    side = lambda df, t, n: df.select("dataset", t.alias("_t"), "z", "y", "x", level.alias("_level")).select("dataset", "_t", "_level", *cells, F.lit(n).alias("_side"))
    both = side(left, F.col("t"), 0).unionByName(side(right, F.col("t") - shift, 1))
    met = both.groupBy("dataset", "_t", "_level", "_cz", "_cy", "_cx").agg(F.count_if(F.col("_side") == 0).alias("a"), F.count_if(F.col("_side") == 1).alias("b"))
    rows = met.groupBy("_level").agg(F.sum("a").alias("n"), F.sum(F.col("a").cast("double") * F.col("b")).alias("pairs")).orderBy("_level").collect()  # a row a width
    fine = [r["_level"] for r in rows if r["pairs"] <= max(FEW_PAIRS if few is None else few, 4 * k * r["n"])]
    return gate / 2 ** (fine[0] if fine else HALVINGS)


def nearest(left: DataFrame, right: DataFrame, k: int, gate: float, shift: int = 0, scale=UNIT, exclude_self: bool = False) -> DataFrame:
    """The k nearest right points within the gate of every left point, ties to the smaller id: adds ``rank``.

    In dense frames the search starts with a smaller gate and only points that
    found fewer than k partners search twice as far, up to the gate: the pairs
    grow with the points and ``k``, not with the points of a whole ball.  Of
    right points in one place only the smallest ids can be among the k.
    """
    place = Window.partitionBy("dataset", "t", "z", "y", "x").orderBy("node_id")
    right = right.select("dataset", "node_id", "t", "z", "y", "x").withColumn("_same", F.row_number().over(place)).filter(F.col("_same") <= k + int(exclude_self)).drop("_same")
    w = Window.partitionBy("dataset", "left_id").orderBy("distance", "right_id")
    now, todo, done = _first_gate(left, right, k, gate, shift, scale), left, None
    while True:
        pairs = radius_join(todo, right, min(now, gate), shift, scale)
        if exclude_self:
            pairs = pairs.filter("left_id <> right_id")
        found = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
        if now >= gate:
            return found if done is None else done.unionByName(found)
        found = stored(found, "nearest")
        full = found.filter(F.col("rank") == k).select("dataset", "left_id")
        some = found.join(full, ["dataset", "left_id"], "left_semi").select(*found.columns)
        done = some if done is None else done.unionByName(some)
        todo = stored(todo.join(full.withColumnRenamed("left_id", "node_id"), ["dataset", "node_id"], "left_anti").select(*left.columns), "short-of-partners")
        now *= 2


def mutual_nearest(left: DataFrame, right: DataFrame, gate: float, shift: int = 0, scale=UNIT) -> DataFrame:
    """Pairs within the gate in which each is the other's nearest, ties to the smaller id: columns of :func:`radius_join`."""
    theirs = nearest(right, left, 1, gate, -shift, scale).select("dataset", F.col("right_id").alias("left_id"), F.col("left_id").alias("right_id"))
    return nearest(left, right, 1, gate, shift, scale).drop("rank").join(theirs, ["dataset", "left_id", "right_id"], "left_semi").select("dataset", "t", "left_id", "right_id", "distance")


def nearest_any(left: DataFrame, right: DataFrame, k: int, gate: float, shift: int = 0, scale=UNIT, exclude_self: bool = False) -> DataFrame:
    """As :func:`nearest` without a gate: points that found fewer than k partners search twice as far, until every point has them all.

    A gate beyond the extent of all points covers every frame, so the rounds
    end; points without finite coordinates have no partners.
    """
    sound = F.lit(True)
    for a in "zyx":
        sound &= F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf"))
    done, todo, right = None, left.filter(sound), right.filter(sound)
    counts = right.groupBy("dataset", F.col("t").alias("_t")).count()
    while True:
        found = nearest(todo, right, k, gate, shift, scale, exclude_self)
        have = found.groupBy("dataset", "left_id").agg(F.count(F.lit(1)).alias("_k")).withColumnRenamed("left_id", "node_id")
        most = todo.withColumn("_t", F.col("t") + shift).join(counts, ["dataset", "_t"]).join(have, ["dataset", "node_id"], "left")
        short = stored(most.filter(F.coalesce("_k", F.lit(0)) < F.least(F.lit(k), F.col("count") - int(exclude_self))).select(*left.columns), "short-of-partners")
        full = found.join(short.select("dataset", F.col("node_id").alias("left_id")), ["dataset", "left_id"], "left_anti").select(*found.columns)
        done = full if done is None else done.unionByName(full)
        if short.isEmpty():
            return done
        todo, gate = short, gate * 2


def within(left: DataFrame, right: DataFrame, gate: float, shift: int = 0, scale=UNIT, anti: bool = False) -> DataFrame:
    """Left points with a right point within the gate, or (anti) without one."""
    hit = radius_join(left, right, gate, shift, scale).select("dataset", F.col("left_id").alias("node_id")).distinct()
    return left.join(hit, ["dataset", "node_id"], "left_anti" if anti else "left_semi").select(*left.columns)


def ball_or_predicted(left: DataFrame, right: DataFrame, predicted: DataFrame, gate: float, shift: int = 1, scale=UNIT) -> DataFrame:
    """Pairs within the gate of the left point or of its predicted position."""
    a = radius_join(left, right, gate, shift, scale).select("dataset", "left_id", "right_id")
    return a.union(radius_join(predicted, right, gate, shift, scale).select("dataset", "left_id", "right_id")).distinct()


def local_spacing(nodes: DataFrame, k: int, gate: float, scale=UNIT) -> DataFrame:
    """Median distance to the k nearest neighbours of the same frame: dataset, node_id, spacing."""
    near = nearest(nodes, nodes, k, gate, 0, scale, exclude_self=True)
    return near.groupBy("dataset", F.col("left_id").alias("node_id")).agg(F.expr("percentile(distance, 0.5)").alias("spacing"))


def motion_features(sources: DataFrame, targets: DataFrame, edges: DataFrame, gate: float, dt: int = 1) -> DataFrame:
    """Eight motion features of every gated pair t -> t + dt: displacement, its length, residual against the source's velocity, its length."""
    prev = edges.alias("e").join(sources.alias("s"), (F.col("e.dataset") == F.col("s.dataset")) & (F.col("e.source") == F.col("s.node_id"))).select(
        F.col("e.dataset").alias("dataset"), F.col("e.target").alias("left_id"), F.col("s.t").alias("pt"), *(F.col(f"s.{a}").alias(f"p{a}") for a in "zyx")
    )
    w = Window.partitionBy("dataset", "left_id").orderBy("pt", "pz", "py", "px")
    prev = prev.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    known = sources.join(prev.withColumnRenamed("left_id", "node_id"), ["dataset", "node_id"], "left")
    pairs = radius_join(known, targets, gate, dt, keep=("z", "y", "x"), left_keep=("pt", "pz", "py", "px"))
    pairs = pairs.withColumnsRenamed({f"{side}_{a}": f"{p}{a}" for side, p in (("left", "s"), ("right", "t")) for a in "zyx"})
    span = F.coalesce(F.col("t") - F.col("pt"), F.lit(1))
    d = {a: F.col(f"t{a}") - F.col(f"s{a}") for a in "zyx"}
    r = {a: d[a] - F.coalesce((F.col(f"s{a}") - F.col(f"p{a}")) / span, F.lit(0.0)) * dt for a in "zyx"}
    return pairs.select(
        "dataset", "left_id", "right_id", *(d[a].alias(f"d{a}") for a in "zyx"), "distance", *(r[a].alias(f"r{a}") for a in "zyx"),
        F.sqrt(r["z"] * r["z"] + r["y"] * r["y"] + r["x"] * r["x"]).alias("residual"),
    )

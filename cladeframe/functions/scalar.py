"""Scalar and per-group functions on probabilities, positions and names, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladeframe.operators.pairs import grouped

EPS = 2.220446049250313e-16


def scale_position(zyx: tuple[Column, Column, Column], scale: tuple[float, float, float]) -> tuple[Column, ...]:
    return tuple(c * F.lit(s) for c, s in zip(zyx, scale))


def probability(c: Column) -> Column:
    """0 for what is not a finite number; a logit outside [0, 1] goes through the logistic function, cut at +-20."""
    d = c.cast("string").try_cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == float("inf"))
    cut = F.greatest(F.lit(-20.0), F.least(F.lit(20.0), d))
    return F.when(bad, 0.0).when((d >= 0) & (d <= 1), d).otherwise(1 / (1 + F.exp(-cut)))


def fuse(forward: Column, backward: Column, how: str, weight: float = 0.5) -> Column:
    """Weighted arithmetic, geometric or harmonic mean of two probabilities; ``weight`` is the backward one's."""
    w = F.lit(weight)
    if how == "arithmetic":
        return (1 - w) * forward + w * backward
    f, b = F.greatest(forward, F.lit(EPS)), F.greatest(backward, F.lit(EPS))
    if how == "geometric":
        return F.exp((1 - w) * F.ln(f) + w * F.ln(b))
    if how == "harmonic":
        return 1 / ((1 - w) / f + w / b)
    raise ValueError(f"unknown fusion {how!r}")


def temper(p: Column, temperature: float) -> Column:
    """sigmoid(logit(p) / temperature) with p kept off 0 and 1."""
    q = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), p))
    return 1 / (1 + F.exp(-(F.ln(q) - F.log1p(-q)) / temperature))


def positional_encoding(coords: list[Column], frequencies: list[float]) -> Column:
    """For each coordinate the sines at all frequencies, then the cosines."""
    return F.array(*(f(c * w) for c in coords for f in (F.sin, F.cos) for w in frequencies))


def nearest_voxel(c: Column, size: int) -> Column:
    """Half-even rounding, kept inside [0, size)."""
    return F.least(F.greatest(F.bround(c, 0).cast("int"), F.lit(0)), F.lit(size - 1))


def unlabelled_weight(target: Column, threshold: float, weight: float) -> Column:
    return F.when(target > threshold, 1.0).otherwise(weight)


def prefix(stem: Column) -> Column:
    return F.substring_index(stem, "_", 1)


def clean_stem(stem: Column) -> Column:
    return F.regexp_replace(stem, r"\.(zarr|geff)$", "")


def odd_kernel(microns: Column, voxel: float) -> Column:
    """Microns in voxels, at least 1, the next odd number."""
    k = F.greatest(F.lit(1), F.bround(microns / voxel, 0).cast("int"))
    return F.when(k % 2 == 0, k + 1).otherwise(k)


def implausible(z: Column, t: Column) -> Column:
    """The signature of fabricated nodes."""
    return (z <= -9000) | (t <= -900)


def _shares(df: DataFrame, keys: list[str], of: dict[str, tuple[str, str]]) -> DataFrame:
    """exp(x - max) / sum for every ``out: (logit, max)``, their sums in one round of figures; drops the columns of maxima."""
    df = df.withColumns({f"_e_{out}": F.exp(F.col(logit) - F.col(top)) for out, (logit, top) in of.items()})
    df = grouped(df, keys, **{f"_total_{out}": F.sum(f"_e_{out}") for out in of})
    df = df.withColumns({out: F.col(f"_e_{out}") / F.col(f"_total_{out}") for out in of})
    return df.drop(*(x for out, (_, top) in of.items() for x in (top, f"_e_{out}", f"_total_{out}")))


def softmax(df: DataFrame, logit: str, keys: list[str], out: str) -> DataFrame:
    """exp(x - max) / sum over the rows with equal ``keys``."""
    return _shares(grouped(df, keys, **{f"_top_{out}": F.max(logit)}), keys, {out: (logit, f"_top_{out}")})


def align(df: DataFrame, values: str, like: str, keys: list[str], out: str, floor: float = 1e-4, low: float = 0.5, high: float = 2.0, tops: tuple[str, str] | None = None) -> DataFrame:
    """``values`` moved to the mean and spread of ``like`` within a group; the ratio of spreads is cut.

    ``tops`` names columns for a group's largest ``like`` and largest ``out``:
    moving keeps the order, so they are known without another round of figures.
    """
    sl, sv, ml, mv = (f"_{x}_{out}" for x in ("sl", "sv", "ml", "mv"))
    most = {tops[0]: F.max(like), tops[1]: F.max(values)} if tops else {}
    df = grouped(df, keys, **{sl: F.stddev_pop(like), sv: F.stddev_pop(values), ml: F.avg(like), mv: F.avg(values)}, **most)
    ratio = F.greatest(F.col(sl), F.lit(floor)) / F.greatest(F.col(sv), F.lit(floor))
    ratio = F.greatest(F.lit(low), F.least(F.lit(high), ratio))
    moved = lambda c: (F.col(c) - F.col(mv)) * ratio + F.col(ml)
    df = df.withColumn(out, moved(values))
    if tops:  # a value that is not finite makes a row of its group NaN, and that is the largest
        df = df.withColumn(tops[1], F.when(F.isnan(sv), float("nan")).otherwise(moved(tops[1])))
    return df.drop(sl, sv, ml, mv)


def bidirectional_logits(df: DataFrame, forward: str, backward: str, keys: list[str], out: str, weight: float = 0.15) -> DataFrame:
    """Backward logits aligned to the forward ones, both softmaxed, harmonic mean, renormalised, as aligned logits."""
    df = align(df, backward, forward, keys, "_aligned", tops=("_top_f", "_top_b"))
    df = _shares(df, keys, {"_pf": (forward, "_top_f"), "_pb": ("_aligned", "_top_b")})
    df = df.withColumn("_h", fuse(F.col("_pf"), F.col("_pb"), "harmonic", weight))
    df = grouped(df, keys, _total_h=F.sum("_h"))
    df = df.withColumn("_l", F.ln(F.greatest(F.col("_h") / F.col("_total_h"), F.lit(EPS))))
    return align(df, "_l", forward, keys, out).drop("_aligned", "_pf", "_pb", "_h", "_total_h", "_l")


def blend_logits(df: DataFrame, first: str, second: str, keys: list[str], order: str, mode: str, out: str, weight: float = 0.5, max_margin: float = 1.0) -> DataFrame:
    """Two models' logits in one: ``raw``, ``calibrated`` (second aligned), ``adaptive`` (weight from margins), ``low_margin_consensus``."""
    margins = mode not in ("raw", "calibrated")
    if mode != "raw":
        df = align(df, second, first, keys, "_b", tops=("_ma1", "_mb1") if margins else None)
    else:
        df = df.withColumn("_b", F.col(second))
    if not margins:
        return df.withColumn(out, (1 - weight) * F.col(first) + weight * F.col("_b")).drop("_b")
    two = ((first, "_ma"), ("_b", "_mb"))
    best = {name: F.col(col) == F.col(name + "1") for col, name in two}
    df = grouped(
        df, keys, **{name + "n": F.count(F.when(best[name], 1)) for _, name in two}, **{name + "2": F.max(F.when(~best[name], F.col(col))) for col, name in two},
        **{name + "s": F.min(F.when(best[name], F.col(order))) for _, name in two},
    )
    for _, name in two:
        top = F.col(name + "1")
        df = df.withColumn(name, top - F.when(F.col(name + "n") > 1, top).otherwise(F.coalesce(name + "2", top)))
    if mode == "adaptive":
        total = F.col("_ma") + F.col("_mb")
        share = F.when(total > 0, F.col("_mb") / total).otherwise(F.lit(0.5))
        use = F.greatest(F.lit(0.15), F.least(F.lit(0.75), share))
    elif mode == "low_margin_consensus":
        doubt = F.greatest(F.lit(0.0), (max_margin - F.col("_ma")) / max_margin)
        use = F.when(F.col("_mas") == F.col("_mbs"), weight * doubt).otherwise(0.0)
    else:
        raise ValueError(f"unknown blend {mode!r}")
    return df.withColumn(out, (1 - use) * F.col(first) + use * F.col("_b")).drop("_b", *(name + x for _, name in two for x in ("", "1", "n", "2", "s")))


def jaccard(tp: Column, fp: Column, fn: Column, empty: float = 1.0) -> Column:
    total = tp + fp + fn
    return F.when(total == 0, empty).otherwise(tp / total)


def adjusted(j: Column, predicted: Column, true: Column, alpha: float = 0.1) -> Column:
    """Jaccard less alpha times the relative excess of nodes, at least 0; more than 1 when too few are predicted."""
    return F.greatest(F.lit(0.0), j * (1 - alpha * (predicted - true) / true))


def golden_section(f, low: float, high: float, steps: int = 60) -> float:
    """Where a one-peaked function is least."""
    r = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - r * (b - a), a + r * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - r * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + r * (b - a)
            fd = f(d)
    return (a + b) / 2

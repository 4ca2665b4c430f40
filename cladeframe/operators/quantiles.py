"""Exact quantiles of many groups without holding a group's values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.scratch import remove, stored

BINS = 1024


def by_size(v: Column) -> Column:
    """An order of doubles by sign and logarithm; 745 makes those of all positive doubles positive."""
    return F.coalesce(F.signum(v) * (F.ln(F.abs(v)) + 745), F.lit(0.0))


def quantiles(df: DataFrame, key: list[str], value: str, at: dict[str, float], weight: str | None = None) -> DataFrame:
    """A row a key with the quantiles ``at`` by name, interpolated between the two values next to them.

    In rounds: the rows between the bounds of a sought rank are counted in
    equal bins (of values, or of their logarithms where bounds are of different
    size), which partial counts hold and merge whatever the rows; the bin with
    the rank gives the next bounds, until they are one value.  A row
    counts ``weight`` times (a whole number; default once).  Null and NaN are
    left out; a key without other values gives no row.
    """
    if not key:
        return quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, at, weight).drop("_all")
    rows = df.select(*key, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("_w")).filter("_v IS NOT NULL AND NOT isnan(_v) AND _w > 0")
    ends = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), (F.lit(q) * (F.col("_n") - 1)).alias("spot")) for name, q in at.items() for side in (0, 1)))
    spot = F.col("_e.spot")
    rank = F.when(F.col("_e.side") == 0, F.floor(spot)).otherwise(F.ceil(spot)).cast("bigint")
    whole = rows.groupBy(*key).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).filter("_n IS NOT NULL")
    sought = whole.withColumn("_e", F.explode(ends)).select(*key, "_e.name", "_e.side", (spot - F.floor(spot)).alias("share"), rank.alias("rank"), "_lo", "_hi")
    sought = stored(sought, "ranks")
    who, found, spent = [*key, "name", "side"], None, []
    while True:
        spent.append(sought)
        done = sought.filter("_lo = _hi")
        found = done if found is None else found.unionByName(done)
        still = sought.filter("_lo < _hi")
        if still.isEmpty():
            break
        pairs = rows.join(still, key).filter("_v >= _lo AND _v <= _hi")
        low, high = F.col("_lo"), F.col("_hi")
        wide = F.when((low > 0) & (high / BINS > low) | (high < 0) & (low / BINS < high), F.lit(True)).when((low <= 0) & (high >= 0), F.lit(len(spent) % 2 == 0)).otherwise(F.lit(False))
        part = F.floor(F.when(wide, (by_size(F.col("_v")) - by_size(low)) / (by_size(high) - by_size(low))).otherwise((F.col("_v") / 2 - low / 2) / (high / 2 - low / 2)) * BINS)
        place = F.when(F.col("_v") >= F.col("_hi"), F.lit(BINS)).when(F.col("_v") <= F.col("_lo"), F.lit(0)).otherwise(F.least(part, F.lit(BINS - 1)))
        counted = pairs.groupBy(*who, "share", "rank", place.alias("_bin")).agg(F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        upto = F.sum("_n").over(Window.partitionBy(*who).orderBy("_bin"))  # at most BINS + 1 rows
        hit = counted.withColumn("_upto", upto).filter("rank < _upto AND rank >= _upto - _n")
        sought = stored(hit.select(*who, "share", (F.col("rank") - F.col("_upto") + F.col("_n")).alias("rank"), "_lo", "_hi"), "ranks")
    cells = []
    for name in at:
        low, high = (F.max(F.when((F.col("name") == name) & (F.col("side") == side), F.col("_lo"))) for side in (0, 1))
        share = F.max(F.when(F.col("name") == name, F.col("share")))
        cells.append(F.when(share < 0.5, low + (high - low) * share).otherwise(high - (high - low) * (1 - share)).alias(name))
    out = stored(found.groupBy(*key).agg(*cells), "quantiles")
    remove(*spent)
    return out

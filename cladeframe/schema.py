"""Tables of the engine and the rules for their values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("node_id", T.LongType()), T.StructField("t", T.IntegerType()),
    T.StructField("z", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.DoubleType()),
])
EDGES = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("source", T.LongType()), T.StructField("target", T.LongType()),
])
#: Node and edge rows in one table; what a row type does not use is -1.
SUBMISSION = T.StructType([
    T.StructField("dataset", T.StringType()), T.StructField("row_type", T.StringType()), T.StructField("node_id", T.LongType()),
    T.StructField("t", T.LongType()), T.StructField("z", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("x", T.DoubleType()),
    T.StructField("source_id", T.LongType()), T.StructField("target_id", T.LongType()),
])


def unused(c: Column) -> Column:
    """A value that a row does not use: null, NaN or -1."""
    d = c.cast("double")
    return d.isNull() | F.isnan(d) | (d == -1)


def id_text(c: Column) -> Column:
    """Ids as text: numbers with no fraction as integers, anything else as it is."""
    d = c.cast("string").try_cast("double")
    whole = d.isNotNull() & ~F.isnan(d) & (F.floor(d).cast("double") == d)
    return F.when(whole, d.cast("bigint").cast("string")).otherwise(c.cast("string"))


def distance(a: str, b: str, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    """Euclidean distance between the positions of two aliased tables, axes scaled by ``scale``."""
    total = None
    for axis, s in zip("zyx", scale):
        d = (F.col(f"{a}.{axis}") - F.col(f"{b}.{axis}")) * s
        total = d * d if total is None else total + d * d
    return F.sqrt(total)

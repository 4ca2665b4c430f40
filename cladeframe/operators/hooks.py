"""Places where a caller's own model takes part in a plan.

A hook is a function from a table to the same rows with columns changed or
added; DataFrame expressions stay in Catalyst's plan, a model's inference is a
pandas function over batches inside it.

* refinement: (…, t, z, y, x) -> the same with moved positions
* gap score: (dataset, source, target, distance) -> adds ``confidence``
* temporal model: frame pairs (dataset, t0, t1, …) -> adds ``heat`` and ``features``
* edge model: candidate edges (dataset, source, target, …) -> adds ``probability``
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Hook = Callable[[DataFrame], DataFrame]


def applied(hook: Hook, rows: DataFrame, *adds: str) -> DataFrame:
    """``hook(rows)`` with the columns of ``rows`` and those it has to add; an error names what is missing."""
    out = hook(rows)
    missing = sorted({*rows.columns, *adds} - set(out.columns))
    if missing:
        raise ValueError(f"the hook left out {missing}")
    return out.select(*rows.columns, *(a for a in adds if a not in rows.columns))


def scored(candidates: DataFrame, model: Hook, column: str = "probability") -> DataFrame:
    """Candidate edges with the edge model's probability, which has to lie in [0, 1]; null where it has none."""
    out = applied(model, candidates, column)
    p = F.col(column)
    return out.withColumn(column, F.when(p.between(0, 1), p).when(p.isNull(), p).otherwise(F.raise_error(F.lit("a probability beyond [0, 1]"))))

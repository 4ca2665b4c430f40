"""The registered queries of the engine and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cladeframe.plans import graphs, images, joins, linking, reports, scalars, scores, tables  # noqa: F401  (they register their queries)
from cladeframe.plans.registry import ORACLES, QUERIES, Query


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.ag13_score(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

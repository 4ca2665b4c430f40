"""Image volumes and lineage graphs in stores of chunked arrays, as tables."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.scratch import placed, remove
from cladeframe.sources.chunked import AXES, array_info, attributes_of, level_of, place_of, register, write_columns

__all__ = ["expanded", "level_of", "read_array", "read_store", "read_graph", "estimated_nodes", "write_graph"]
GRAPH_PROPS = ("t", "z", "y", "x")


def expanded(voxels: DataFrame, dataset: str | None = None) -> DataFrame:
    """dataset, t, c, z, y, x, value of a voxel table with three (z, y, x) or four (t, z, y, x) axes or all five; what is missing is 0."""
    lacking = sorted({"z", "y", "x", "value"} - set(voxels.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    name = F.col("dataset") if "dataset" in voxels.columns else F.lit(dataset or "")
    axes = [(F.col(a) if a in voxels.columns else F.lit(0)).cast("int").alias(a) for a in AXES]
    return voxels.select(name.alias("dataset"), *axes, F.col("value").cast("double").alias("value"))


def read_array(spark: SparkSession, path: str, dataset: str = "", missing: str = "skip") -> DataFrame:
    """Voxels of an array folder; chunks without a file give no rows, or rows of the fill value if ``missing`` is "fill"."""
    if array_info(*place_of(path)) is None:
        raise FileNotFoundError(f"no array at {path}")
    register(spark)
    return spark.read.format("chunked_arrays").option("dataset", dataset).option("missing", missing).load(path)


def read_store(spark: SparkSession, path: str, level: int = 0, dataset: str = "", missing: str = "skip") -> tuple[DataFrame, tuple[float, float, float]]:
    """(voxels, voxel size) of a level of a multiscale store; the size is 1 where the metadata have none."""
    name, size = level_of(attributes_of(*place_of(path)) or {}, level)
    return read_array(spark, f"{path}/{name}", dataset, missing), size or (1.0, 1.0, 1.0)


def _searched(tree: Any, name: str) -> Any:
    """The value of the first key ``name`` in nested metadata, nearest to the root."""
    level = [tree]
    while level:
        for part in level:
            if isinstance(part, dict) and part.get(name) is not None:
                return part[name]
        level = [x for part in level for x in (part.values() if isinstance(part, dict) else part if isinstance(part, list) else ())]
    return None


def estimated_nodes(spark: SparkSession, path: str, nodes: DataFrame) -> float:
    """``estimated_number_of_nodes`` from the metadata of the store, its ``nodes`` or its ``edges``; without it the number of nodes read."""
    files, base = place_of(path)
    for part in ("", "/nodes", "/edges"):
        found = _searched(attributes_of(files, base + part) or {}, "estimated_number_of_nodes")
        if found is not None:
            return float(found)
    return float(nodes.count())


def read_graph(spark: SparkSession, path: str, dataset: str, scale: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph store; positions times ``scale``.

    A store has arrays ``nodes/ids``, ``nodes/props/<t, z, y, x>/values`` and
    ``edges/ids`` (two columns; without it there are no edges), or Parquet
    tables ``nodes`` (id, t, z, y, x) and ``edges`` (source, target).
    """
    files, base = place_of(path)
    if array_info(files, f"{base}/nodes/ids") is None:
        n, e = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")
    else:
        register(spark)
        said = "id=nodes/ids," + ",".join(f"{a}=nodes/props/{a}/values" for a in GRAPH_PROPS)
        n = spark.read.format("chunked_columns").schema("id bigint, t int, z double, y double, x double").option("columns", said).load(path)
        if array_info(files, f"{base}/edges/ids") is None:
            e = spark.createDataFrame([], "source bigint, target bigint")
        else:
            e = spark.read.format("chunked_columns").schema("source bigint, target bigint").option("columns", "source=edges/ids:0,target=edges/ids:1").load(path)
    nodes = n.select(F.lit(dataset).alias("dataset"), F.col("id").cast("bigint").alias("node_id"), F.col("t").cast("int").alias("t"), *((F.col(a).cast("double") * s).alias(a) for a, s in zip("zyx", scale)))
    return nodes, e.select(F.lit(dataset).alias("dataset"), F.col("source").cast("bigint").alias("source"), F.col("target").cast("bigint").alias("target"))


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, estimated: float | None = None, chunk: int = 1 << 16) -> None:
    """A graph store of arrays from node and edge tables (of one dataset), rows by id; the group's metadata last."""
    for rows, order, arrays in (
        (nodes.select("node_id", *GRAPH_PROPS), ["node_id"], {"nodes/ids": (["node_id"], "int64"), "nodes/props/t/values": (["t"], "int64"), **{f"nodes/props/{a}/values": ([a], "float64") for a in "zyx"}}),
        (edges.select("source", "target"), ["source", "target"], {"edges/ids": (["source", "target"], "int64")}),
    ):
        numbered = placed(rows, order, "graph-rows")
        n = numbered.count()
        if n:
            write_columns(numbered, n, path, arrays, chunk)
        remove(numbered)
    files, base = place_of(path)
    said = {"zarr_format": 3, "node_type": "group", "attributes": {} if estimated is None else {"geff": {"extra": {"estimated_number_of_nodes": estimated}}}}
    files.create_dir(base, recursive=True)
    with files.open_output_stream(f"{base}/zarr.json") as f:
        f.write(json.dumps(said).encode())

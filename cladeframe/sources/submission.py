"""Reading, checking and writing submission tables, evaluation inputs and logs."""

from __future__ import annotations

import hashlib
import os

from pyarrow.fs import FileSelector, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.schema import SUBMISSION, id_text, unused
from cladeframe.scratch import placed
from cladeframe.sources.chunked import place_of

COLUMNS = SUBMISSION.fieldNames()
PIECE = 1 << 20


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text by the header's names; what is not among the nine required ones is dropped."""
    df = spark.read.option("header", True).csv(path)
    missing = sorted(set(COLUMNS) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*COLUMNS)


def violations(rows: DataFrame, next_frame_only: bool = False) -> DataFrame:
    """dataset, rule, id of every broken rule of a submission."""
    num = lambda c: F.col(c).cast("string").try_cast("double")
    finite = lambda c: num(c).isNotNull() & ~F.isnan(num(c)) & (F.abs(num(c)) < float("inf"))
    df = rows.withColumn("_id", id_text(F.col("node_id"))).withColumn("_s", id_text(F.col("source_id"))).withColumn("_t", id_text(F.col("target_id")))
    node, edge = df.filter("row_type = 'node'"), df.filter("row_type = 'edge'")
    hit = lambda d, name, id_: d.select("dataset", F.lit(name).alias("rule"), F.col(id_).alias("id"))
    out = hit(df.filter("row_type IS NULL OR row_type NOT IN ('node', 'edge')").withColumn("_x", F.coalesce("row_type", F.lit("null"))), "row_type", "_x")
    out = out.unionByName(hit(node.groupBy("dataset", "_id").count().filter("count > 1"), "duplicate_node", "_id"))
    out = out.unionByName(hit(node.filter(~unused(F.col("source_id")) | ~unused(F.col("target_id"))), "node_sentinel", "_id"))
    bad_edge = ~unused(F.col("node_id")) | ~unused(F.col("t")) | ~unused(F.col("z")) | ~unused(F.col("y")) | ~unused(F.col("x"))
    out = out.unionByName(hit(edge.filter(bad_edge), "edge_sentinel", "_s"))
    out = out.unionByName(hit(node.filter(~(finite("t") & finite("z") & finite("y") & finite("x"))), "not_finite", "_id"))
    ids = node.select("dataset", F.col("_id").alias("_e")).distinct()
    ends = edge.select("dataset", F.col("_s").alias("_e")).union(edge.select("dataset", F.col("_t").alias("_e"))).distinct()
    out = out.unionByName(hit(ends.join(ids, ["dataset", "_e"], "left_anti"), "dangling_edge", "_e"))
    if next_frame_only:
        at = node.select("dataset", F.col("_id").alias("_e"), num("t").alias("_w")).dropDuplicates(["dataset", "_e"])
        timed = edge.join(at.withColumnsRenamed({"_e": "_s", "_w": "_ws"}), ["dataset", "_s"]).join(at.withColumnsRenamed({"_e": "_t", "_w": "_wt"}), ["dataset", "_t"])
        out = out.unionByName(hit(timed.filter("_wt <> _ws + 1"), "not_next_frame", "_s"))
    return out


def to_graph(rows: DataFrame, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges); strict: raises if a rule is broken."""
    if strict:
        first = violations(rows).first()
        if first is not None:
            raise ValueError(f"{first['dataset']}: {first['rule']} ({first['id']})")
    d = lambda c: F.col(c).cast("double").alias(c)
    nodes = rows.filter("row_type = 'node'").select("dataset", F.col("node_id").cast("bigint").alias("node_id"), F.col("t").cast("int").alias("t"), d("z"), d("y"), d("x"))
    edges = rows.filter("row_type = 'edge'").select("dataset", F.col("source_id").cast("bigint").alias("source"), F.col("target_id").cast("bigint").alias("target")).distinct()
    return nodes, edges


def ordered(rows: DataFrame) -> DataFrame:
    """Export order: dataset, nodes by (t, id as text), then edges by (source, target) as text."""
    return rows.orderBy("dataset", F.col("row_type") == "edge", "t", F.col("node_id").cast("string"), F.col("source_id").cast("string"), F.col("target_id").cast("string"))


def write_csv(rows: DataFrame, path: str) -> None:
    """One ordered file, as consumers of submissions expect."""
    ordered(rows.select(*COLUMNS)).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def numbered(rows: DataFrame) -> DataFrame:
    """Rows with coordinates rounded half to even and not below 0, and one running ``id`` through all datasets.

    Within a dataset nodes come first, by id, then edges by source and target.
    Raises if an edge has an end that is not among its dataset's nodes.
    """
    used = F.col("row_type") == "node"
    ids = rows.filter(used).select("dataset", F.col("node_id").alias("_e"))
    ends = rows.filter(~used).select("dataset", F.explode(F.array("source_id", "target_id")).alias("_e"))
    loose = ends.join(ids, ["dataset", "_e"], "left_anti").first()
    if loose is not None:
        raise ValueError(f"{loose['dataset']}: dangling edge ({loose['_e']})")
    at = lambda c: F.when(used, F.greatest(F.lit(0.0), F.bround(F.col(c), 0))).otherwise(F.col(c)).cast("bigint").alias(c)
    df = placed(rows.withColumn("_edge", ~used), ["dataset", "_edge", "node_id", "source_id", "target_id"], "numbered")
    return df.select(F.col("_at").alias("id"), "dataset", "row_type", "node_id", "t", at("z"), at("y"), at("x"), "source_id", "target_id")


def node_estimates(df: DataFrame) -> DataFrame:
    """dataset, estimate from either naming of the columns; empty if they are missing."""
    name = next((c for c in ("volume", "dataset") if c in df.columns), None)
    value = next((c for c in ("est", "estimated_number_of_nodes") if c in df.columns), None)
    if name is None or value is None:
        return df.sparkSession.createDataFrame([], "dataset string, estimate bigint")
    return df.select(F.col(name).cast("string").alias("dataset"), F.bround(F.col(value).cast("double"), 0).cast("bigint").alias("estimate"))


def pack_folds(df: DataFrame, twin: str | None = "is_public_test_twin") -> DataFrame:
    """fold, dataset, role (train or evaluate) from columns fold_<x>_role; twins are left out."""
    names = [c for c in df.columns if c.lower().startswith("fold_") and c.lower().endswith("_role")]
    if twin and twin in df.columns:
        df = df.filter(~F.coalesce(F.col(twin).cast("boolean"), F.lit(False)))
    roles = F.array(*(F.struct(F.lit(c.split("_")[1].upper()).alias("fold"), F.col(c).alias("role")) for c in names))
    return df.select(F.col("volume").alias("dataset"), F.explode(roles).alias("r")).select(
        F.col("r.fold").alias("fold"), "dataset", F.when(F.col("r.role") == "evaluate", "evaluate").otherwise("train").alias("role")
    )


def appended(log: DataFrame, fresh: DataFrame, key: list[str], value: str, tolerance: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(log with the new rows, conflicts): rows whose key is known are dropped if the values agree within the tolerance, else conflicts."""
    known = log.select(*key, F.col(value).alias("_old"))
    conflicts = fresh.join(known, key).filter(F.abs(F.col(value) - F.col("_old")) > tolerance).select(*key, value, "_old")
    return log.unionByName(fresh.join(known, key, "left_anti").select(*log.columns)), conflicts


#: Fields of a row of the experiment log, in order; the first eight are required.
LOG = (
    "candidate string, score double, adjusted_edge_jaccard double, division_jaccard double, split string, split_provenance string, scorer_provenance string, commit_sha string, "
    "config_path string, config_sha256 string, public_lb double, private_lb double, notes string, created_at string"
)


def log_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with all fields of the log: texts that are missing are empty, boards null, ``created_at`` the present time in UTC if empty."""
    fields = [f.split() for f in LOG.split(", ")]
    missing = sorted({n for n, _ in fields[:8]} - set(rows.columns))
    if missing:
        raise ValueError(f"missing fields: {missing}")
    cols = []
    for name, kind in fields:
        here = F.col(name) if name in rows.columns else F.lit(None)
        here = here.cast(kind)
        if kind == "string":
            here = F.coalesce(here, F.lit(""))
        if name == "created_at":
            here = F.when(here == "", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")).otherwise(here)
        cols.append(here.alias(name))
    return rows.select(*cols)


def append_log(rows: DataFrame, path: str) -> DataFrame:
    """Append to the log; rows that are there stay.  Returns the whole log."""
    log_rows(rows).write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(LOG).parquet(path)


def tree_digest(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of every file below a folder that is not empty."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"))


def directory_digest(spark: SparkSession, path: str, head: bytes = b"directory-artifact-v1\0") -> str:
    """One SHA-256 over a folder: ``head``, then for every file, by relative path, the lengths and bytes of path and content; over a single file its bytes.

    A hash of a sequence is sequential by nature, so one process reads the
    files, PIECE bytes at a time.  Symbolic links are an error.
    """
    files, base = place_of(path)

    def checked(name: str) -> str:
        if isinstance(files, LocalFileSystem) and os.path.islink(name):
            raise ValueError(f"symbolic link: {name}")
        return name

    def pieces(name: str):
        with files.open_input_stream(name) as f:
            while piece := f.read(PIECE):
                yield piece

    kind = files.get_file_info(checked(base)).type
    digest = hashlib.sha256(head if kind == FileType.Directory else b"")
    if kind == FileType.NotFound:
        raise FileNotFoundError(path)
    if kind != FileType.Directory:
        for piece in pieces(base):
            digest.update(piece)
        return digest.hexdigest()
    found = {checked(x.path)[len(base) :].lstrip("/"): x for x in files.get_file_info(FileSelector(base, recursive=True))}
    inside = [(name, found[name]) for name in sorted(found) if found[name].type == FileType.File]
    if not inside:
        raise ValueError(f"no files below {path}")
    for name, x in inside:
        digest.update(len(name.encode()).to_bytes(8, "big") + name.encode() + x.size.to_bytes(8, "big"))
        for piece in pieces(x.path):
            digest.update(piece)
    return digest.hexdigest()

"""A Spark data source of chunked arrays: stores of the second and third version of the zarr layout.

``spark.read.format("chunked_arrays").load(path)`` gives voxel rows of a store,
of a plain array, or of a folder of ``*.zarr`` stores (one dataset each).  A
partition is a run of chunks; filters on ``dataset`` and on the axes choose
the chunks before any is opened.  ``chunked_columns`` gives the rows of arrays
that share their first axis as columns, as graph stores keep them.  Written
are chunks that come as rows (:func:`encoded`), metadata last, so a store is
readable when it is whole; a task that runs again writes the same files.

Files are opened with pyarrow's file systems, in the tasks.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterator
from typing import Any, NamedTuple
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from cladeframe.sources import blosc

AXES = ("t", "c", "z", "y", "x")
VOXELS = "dataset string, t int, c int, z int, y int, x int, value double"
CHUNKS = "array string, shape array<bigint>, chunk array<bigint>, place array<bigint>, dtype string, fill double, content binary"
#: Partitions of a scan at most; beyond it a partition has several chunks.
MOST_PARTITIONS = 20_000
#: Rows of a batch that a chunk is handed on in.
BATCH_ROWS = 1 << 16


def place_of(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or address."""
    if urlparse(path).scheme in ("", "file"):
        return pafs.LocalFileSystem(), "/" + unquote(path.removeprefix("file:")).strip("/")
    files, base = pafs.FileSystem.from_uri(path)
    return files, base.rstrip("/")


def read_bytes(files: pafs.FileSystem, path: str) -> bytes | None:
    """A file's bytes; None if there is none."""
    if files.get_file_info(path).type != pafs.FileType.File:
        return None
    with files.open_input_stream(path) as f:
        return f.read()


def read_json(files: pafs.FileSystem, path: str) -> dict | None:
    raw = read_bytes(files, path)
    return None if raw is None else json.loads(raw)


def step_into(tree: Any, *steps: str | int) -> Any:
    """What lies at the end of the steps; None if a step leads nowhere."""
    for s in steps:
        if isinstance(tree, dict) and s in tree or isinstance(tree, list) and isinstance(s, int) and -len(tree) <= s < len(tree):
            tree = tree[s]
        else:
            return None
    return tree


def attributes_of(files: pafs.FileSystem, base: str) -> dict | None:
    """Attributes of a group or array of either version; None if there is neither."""
    new = read_json(files, f"{base}/zarr.json")
    if new is not None:
        return new.get("attributes") or {}
    old = [read_json(files, f"{base}/{name}") for name in (".zattrs", ".zgroup", ".zarray")]
    return None if all(x is None for x in old) else old[0] or {}


def level_of(attributes: dict, level: int = 0) -> tuple[str, tuple[float, float, float] | None]:
    """(path, voxel size z, y, x or None) of a resolution level; without usable metadata the level's number and None."""
    scales = step_into(attributes, "multiscales", 0) or step_into(attributes, "ome", "multiscales", 0)
    path = step_into(scales, "datasets", level, "path")
    if not isinstance(path, str):
        return str(level), None
    names = [step_into(axis, "name") for axis in step_into(scales, "axes") or []]
    size: dict[str, float] = {}
    for change in reversed(step_into(scales, "datasets", level, "coordinateTransformations") or []):  # the first scale has the last word
        if step_into(change, "type") == "scale":
            size |= dict(zip(names, change["scale"]))
    return path, tuple(float(size[a]) for a in "zyx") if {"z", "y", "x"} <= size.keys() else None


class ArrayInfo(NamedTuple):
    """What is needed to find and decode the chunks of an array."""

    shape: tuple[int, ...]
    chunk: tuple[int, ...]
    dtype: str
    order: str
    fill: float
    codecs: tuple[tuple[str, str], ...]
    #: First part of a chunk's key and what joins its numbers.
    head: str
    joint: str


def _number(x: Any) -> float:
    return 0.0 if x is None else float(x)  # also "NaN", "Infinity"


def array_info(files: pafs.FileSystem, base: str) -> ArrayInfo | None:
    """Metadata of the array in a folder; None if there is no array."""
    new = read_json(files, f"{base}/zarr.json")
    if new is not None:
        if new.get("node_type") != "array":
            return None
        if step_into(new, "chunk_grid", "name") != "regular":
            raise ValueError(f"{base}: chunks of an array are on a regular grid")
        codecs = [(c["name"], c.get("configuration") or {}) for c in new["codecs"]]
        endian = next((c.get("endian", "little") for name, c in codecs if name == "bytes"), "little")
        kind = np.dtype(new["data_type"]).newbyteorder("<" if endian == "little" else ">")
        coded = step_into(new, "chunk_key_encoding") or {}
        plain = coded.get("name", "default") == "default"
        joint = step_into(coded, "configuration", "separator") or ("/" if plain else ".")
        packed = tuple((name, json.dumps(c)) for name, c in codecs if name not in ("bytes", "crc32c"))
        return ArrayInfo(tuple(new["shape"]), tuple(step_into(new, "chunk_grid", "configuration", "chunk_shape")), kind.str, "C", _number(new.get("fill_value")), packed, "c" if plain else "", joint)
    old = read_json(files, f"{base}/.zarray")
    if old is None:
        return None
    if old.get("filters"):
        raise ValueError(f"{base}: filters have no decoder")
    packer = old.get("compressor")
    packed = () if not packer else ((packer["id"], "{}"),)
    return ArrayInfo(tuple(old["shape"]), tuple(old["chunks"]), old["dtype"], old.get("order", "C"), _number(old.get("fill_value")), packed, "", old.get("dimension_separator", "."))


def chunk_path(base: str, info: ArrayInfo, place: tuple[int, ...]) -> str:
    return f"{base}/" + info.joint.join([*([info.head] if info.head else []), *map(str, place)])


def unpacked(raw: bytes, codecs: tuple[tuple[str, str], ...]) -> bytes:
    for name, _ in reversed(codecs):
        if name == "blosc":
            raw = blosc.decompress(raw)
        elif name in ("gzip", "zlib"):
            import zlib

            raw = zlib.decompress(raw, 47)
        elif name == "zstd":
            import zstandard

            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        else:
            raise ValueError(f"no decoder for {name}")
    return raw


def read_chunk(files: pafs.FileSystem, base: str, info: ArrayInfo, place: tuple[int, ...], missing: str) -> np.ndarray | None:
    """The part of a chunk inside the array; without a file the fill value, or None if ``missing`` is "skip"."""
    inside = tuple(slice(0, min(c, s - p * c)) for c, s, p in zip(info.chunk, info.shape, place))
    raw = read_bytes(files, chunk_path(base, info, place))
    if raw is None:
        return None if missing == "skip" else np.full([s.stop for s in inside], info.fill, np.dtype(info.dtype))
    return np.frombuffer(unpacked(raw, info.codecs), np.dtype(info.dtype)).reshape(info.chunk, order=info.order)[inside]


class Run(InputPartition):
    """Chunks ``start`` to ``stop`` of the product of the chosen chunk numbers by axis."""

    def __init__(self, dataset: str, base: str, info: ArrayInfo | None, chosen: list[list[int]], start: int, stop: int) -> None:
        self.dataset, self.base, self.info, self.chosen, self.start, self.stop = dataset, base, info, chosen, start, stop

    def places(self) -> Iterator[tuple[int, ...]]:
        sizes = [len(c) for c in self.chosen]
        for i in range(self.start, self.stop):
            yield tuple(c[k] for c, k in zip(self.chosen, np.unravel_index(i, sizes)))


class Wanted:
    """What pushed filters leave of integer axes and of the dataset."""

    def __init__(self) -> None:
        self.low: dict[str, float] = {}
        self.high: dict[str, float] = {}
        self.among: dict[str, set] = {}

    def take(self, f) -> None:
        if len(getattr(f, "attribute", ())) != 1 or getattr(f, "value", None) is None:
            return
        name, v = f.attribute[0], f.value
        if isinstance(f, (EqualTo, In)):
            values = set(v) if isinstance(f, In) else {v}
            self.among[name] = self.among.get(name, values) & values
        elif name in AXES and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            v = math.floor(v) + 1 if isinstance(f, GreaterThan) else v  # places are whole numbers
            self.low[name] = max(self.low.get(name, v), v)
        elif name in AXES and isinstance(f, (LessThan, LessThanOrEqual)):
            v = math.ceil(v) - 1 if isinstance(f, LessThan) else v
            self.high[name] = min(self.high.get(name, v), v)

    def dataset(self, name: str) -> bool:
        return name in self.among.get("dataset", {name})

    def chunks(self, axis: str, size: int, chunk: int) -> list[int]:
        """Numbers of the chunks along an axis that can hold wanted rows."""
        low, high = self.low.get(axis, -math.inf), self.high.get(axis, math.inf)
        among = self.among.get(axis)
        found = range(-(-size // chunk)) if among is None else sorted({int(v) // chunk for v in among if 0 <= v < size})
        return [k for k in found if k * chunk <= high and min(size, (k + 1) * chunk) - 1 >= low]


class VoxelReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.level, self.missing = options["path"], int(options.get("level", "0")), options.get("missing", "fill")
        self.dataset = options.get("dataset")
        self.wanted = Wanted()

    def pushFilters(self, filters):
        """Every filter narrows the chunks and is still evaluated by Spark."""
        for f in filters:
            self.wanted.take(f)
        return filters

    def arrays(self) -> Iterator[tuple[str, str, ArrayInfo]]:
        files, base = place_of(self.path)
        whole = attributes_of(files, base)
        if whole is None:
            stores = [x.path for x in files.get_file_info(pafs.FileSelector(base)) if x.type == pafs.FileType.Directory and x.base_name.endswith(".zarr")]
        else:
            stores = [base]
        for store in sorted(stores):
            name = self.dataset if self.dataset is not None and whole is not None else store.rpartition("/")[2].removesuffix(".zarr")
            if not self.wanted.dataset(name):
                continue
            info = array_info(files, store)
            if info is None:
                store = f"{store}/{level_of(attributes_of(files, store) or {}, self.level)[0]}"
                info = array_info(files, store)
            if info is None:
                raise FileNotFoundError(f"no array at {store}")
            if not 3 <= len(info.shape) <= 5:
                raise ValueError("an array has three to five axes")
            yield name, store, info

    def partitions(self):
        found = []
        for name, store, info in self.arrays():
            chosen = [self.wanted.chunks(a, s, c) for a, s, c in zip(axes_of(info), info.shape, info.chunk)]
            if all(self.wanted.chunks(a, 1, 1) for a in set(AXES) - set(axes_of(info))):  # an axis that is not there is 0
                found.append((name, store, info, chosen, math.prod(map(len, chosen))))
        step = max(1, -(-sum(n for *_, n in found) // MOST_PARTITIONS))
        runs = [Run(*x, at, min(n, at + step)) for *x, n in found for at in range(0, n, step)]
        return runs or [Run("", "", None, [], 0, 0)]

    def read(self, run: Run):
        files, _ = place_of(self.path)
        for place in run.places():
            values = read_chunk(files, run.base, run.info, place, self.missing)
            if values is None:
                continue
            flat, names = values.ravel(), axes_of(run.info)
            for at in range(0, len(flat), BATCH_ROWS):
                part = np.arange(at, min(len(flat), at + BATCH_ROWS))
                where = dict(zip(names, np.unravel_index(part, values.shape)))
                corner = {a: p * c for a, p, c in zip(names, place, run.info.chunk)}
                axes = [pa.array((where[a] + corner[a] if a in where else np.zeros(len(part))).astype(np.int32)) for a in AXES]
                yield pa.RecordBatch.from_arrays([pa.array([run.dataset] * len(part)), *axes, pa.array(flat[part].astype(np.float64))], names=["dataset", *AXES, "value"])


def axes_of(info: ArrayInfo) -> tuple[str, ...]:
    return {3: AXES[2:], 4: ("t", *AXES[2:]), 5: AXES}[len(info.shape)]


class ColumnReader(DataSourceReader):
    """Rows of one-dimensional arrays (or of the columns of a two-dimensional one) below ``path``.

    Option ``columns``: "name=array" or "name=array:column", separated by
    commas; all arrays have the same number of rows.  Rows are dealt by the
    first array's chunks; the others' are read where they overlap.
    """

    def __init__(self, options: dict, schema) -> None:
        self.path, self.schema = options["path"], schema
        self.columns = {}
        for said in options["columns"].split(","):
            name, _, at = said.partition("=")
            array, _, k = at.partition(":")
            self.columns[name.strip()] = (array.strip(), int(k) if k else None)

    def infos(self) -> dict[str, ArrayInfo]:
        files, base = place_of(self.path)
        out = {a: array_info(files, f"{base}/{a}") for a, _ in self.columns.values()}
        lacking = sorted(a for a, i in out.items() if i is None)
        if lacking:
            raise FileNotFoundError(f"no arrays {lacking} below {self.path}")
        if len({i.shape[0] for i in out.values()}) > 1:
            raise ValueError("arrays of different length")
        return out

    def partitions(self):
        info = self.infos()[next(iter(self.columns.values()))[0]]
        n = -(-info.shape[0] // info.chunk[0])
        step = max(1, -(-n // MOST_PARTITIONS))
        return [Run("", "", info, [], at, min(n, at + step)) for at in range(0, n, step)] or [Run("", "", None, [], 0, 0)]

    def rows(self, files, base: str, info: ArrayInfo, low: int, high: int) -> np.ndarray:
        """Rows low to high of an array, whatever its chunks."""
        parts = []
        for k in range(low // info.chunk[0], -(-high // info.chunk[0])):
            across = [read_chunk(files, base, info, (k, *rest), "fill") for rest in itertools.product(*(range(-(-s // c)) for s, c in zip(info.shape[1:], info.chunk[1:])))]
            block = across[0] if len(across) == 1 else np.concatenate(across, axis=1)
            parts.append(block[max(0, low - k * info.chunk[0]) : high - k * info.chunk[0]])
        return np.concatenate(parts)

    def read(self, run: Run):
        if run.info is None:
            return
        files, base = place_of(self.path)
        infos = self.infos()
        for k in range(run.start, run.stop):
            low, high = k * run.info.chunk[0], min((k + 1) * run.info.chunk[0], run.info.shape[0])
            held = {a: self.rows(files, f"{base}/{a}", i, low, high) for a, i in infos.items()}
            cols = []
            for field in self.schema:
                array, column = self.columns[field.name]
                values = held[array] if column is None else held[array][:, column]
                kind = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}[field.dataType.simpleString()]
                cols.append(pa.array(values.astype(kind.to_pandas_dtype())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in self.schema])


class Written(WriterCommitMessage):
    def __init__(self, arrays: dict[str, tuple]) -> None:
        self.arrays = arrays


class ChunkWriter(DataSourceWriter):
    """One file a row of CHUNKS; the arrays' metadata once all chunks are there."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, iterator):
        files, base = place_of(self.path)
        arrays = {}
        for row in iterator:
            arrays[row["array"]] = (list(row["shape"]), list(row["chunk"]), row["dtype"], row["fill"])
            target = f"{base}/{row['array']}/c/" + "/".join(map(str, row["place"]))
            files.create_dir(target.rpartition("/")[0], recursive=True)
            with files.open_output_stream(target) as f:
                f.write(bytes(row["content"]))
        return Written(arrays)

    def commit(self, messages):
        files, base = place_of(self.path)
        for array, (shape, chunk, dtype, fill) in {k: v for m in messages if m is not None for k, v in m.arrays.items()}.items():
            said = {
                "zarr_format": 3, "node_type": "array", "shape": shape, "data_type": np.dtype(dtype).name,
                "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}}, "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}},
                "fill_value": "NaN" if math.isnan(fill) else fill if np.dtype(dtype).kind == "f" else int(fill),
                "codecs": [{"name": "bytes", "configuration": {"endian": "little"}}, {"name": "zstd", "configuration": {"level": 3, "checksum": False}}], "attributes": {},
            }
            with files.open_output_stream(f"{base}/{array}/zarr.json") as f:
                f.write(json.dumps(said).encode())


class ChunkedArrays(DataSource):
    """Voxels of array stores; written are chunks as rows."""

    @classmethod
    def name(cls) -> str:
        return "chunked_arrays"

    def schema(self) -> str:
        return VOXELS

    def reader(self, schema):
        return VoxelReader(self.options)

    def writer(self, schema, overwrite):
        return ChunkWriter(self.options)


class ChunkedColumns(DataSource):
    """Arrays of one length as the columns of a table; needs a schema."""

    @classmethod
    def name(cls) -> str:
        return "chunked_columns"

    def reader(self, schema):
        return ColumnReader(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the two formats known to a session and lets Spark hand their filters down."""
    spark.dataSource.register(ChunkedArrays)
    spark.dataSource.register(ChunkedColumns)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def encoded(parts: DataFrame, dtype: str, fill: float) -> DataFrame:
    """Rows of CHUNKS from (array, shape, chunk, place, held: array of (offset, value)); offsets count in C order within the chunk."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        kind = np.dtype(dtype).newbyteorder("<")
        for batch in batches:
            content = []
            for chunk, held in zip(batch.column("chunk").to_pylist(), batch.column("held")):
                values = np.full(math.prod(chunk), fill).astype(kind)
                at, v = held.values.field(0), held.values.field(1)
                values[at.to_numpy()] = v.to_numpy(zero_copy_only=False).astype(kind)
                content.append(pack.compress(values.tobytes()))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("array", "shape", "chunk", "place")), pa.array([dtype] * n), pa.array([fill] * n, pa.float64()), pa.array(content, pa.binary())],
                names=["array", "shape", "chunk", "place", "dtype", "fill", "content"],
            )

    return parts.select("array", "shape", "chunk", "place", "held").mapInArrow(run, CHUNKS)


def write_voxels(voxels: DataFrame, path: str, chunk: tuple[int, int, int, int, int], fill: float = float("nan")) -> None:
    """A store ``<dataset>.zarr`` with level 0 for every dataset of a voxel table; a task holds one chunk at a time."""
    register(voxels.sparkSession)
    sizes = voxels.groupBy("dataset").agg(F.array(*((F.max(a) + 1).cast("bigint") for a in AXES)).alias("shape"))
    offset = F.lit(0)
    for a, c in zip(AXES, chunk):
        offset = offset * c + F.col(a) % c
    place = F.array(*(F.floor(F.col(a) / c).cast("bigint") for a, c in zip(AXES, chunk)))
    parts = voxels.groupBy("dataset", place.alias("place")).agg(F.collect_list(F.struct(offset.cast("int").alias("offset"), F.col("value").cast("double").alias("value"))).alias("held"))
    parts = parts.join(sizes, "dataset").withColumn("array", F.concat("dataset", F.lit(".zarr/0"))).withColumn("chunk", F.array(*(F.lit(c).cast("bigint") for c in chunk)))
    encoded(parts, "float64", fill).write.format("chunked_arrays").mode("append").save(path)


def write_columns(rows: DataFrame, n: int, path: str, arrays: dict[str, tuple[list[str], str]], chunk: int = 1 << 16) -> None:
    """Arrays below ``path`` from the columns of ``rows``, which are numbered from 0 to n - 1 in ``_at``; arrays: name -> (columns, dtype)."""
    register(rows.sparkSession)
    for array, (columns, dtype) in arrays.items():
        width = len(columns)
        cells = rows.select(F.floor(F.col("_at") / chunk).alias("k"), F.posexplode(F.array(*(F.col(c).cast("double" if dtype.startswith("float") else "bigint") for c in columns))).alias("j", "value"), ((F.col("_at") % chunk) * width).alias("o"))
        held = cells.groupBy("k").agg(F.collect_list(F.struct((F.col("o") + F.col("j")).cast("int").alias("offset"), "value")).alias("held"))
        shape, size = ([n], [chunk]) if width == 1 else ([n, width], [chunk, width])
        numbers = lambda xs: F.array(*(F.lit(x).cast("bigint") for x in xs))
        place = F.array("k") if width == 1 else F.array("k", F.lit(0).cast("bigint"))
        parts = held.select(F.lit(array).alias("array"), numbers(shape).alias("shape"), numbers(size).alias("chunk"), place.alias("place"), "held")
        encoded(parts, dtype, 0.0).write.format("chunked_arrays").mode("append").save(path)

"""Array and graph stores: both versions, codecs, pruning by filters, fill values, round trips."""

import gzip
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from cladeframe.sources import blosc, chunked, volumes


def blosc_frame(raw, width, block, codec=1, shuffle=True, split=True):
    """A frame by the format's description; the first stream is stored as it is."""
    pack = {1: lambda b: pa.Codec("lz4_raw").compress(b, asbytes=True), 3: zlib.compress, 4: zstandard.ZstdCompressor().compress}[codec]
    blocks = []
    for at in range(0, len(raw), block):
        part = raw[at : at + block]
        if shuffle:
            n = len(part) // width
            part = np.frombuffer(part[: n * width], np.uint8).reshape(n, width).T.tobytes() + part[n * width :]
        streams = width if split and width <= 16 and block // width >= 128 and len(part) == block else 1
        size, out = len(part) // streams, b""
        for k in range(streams):
            piece = part[k * size : (k + 1) * size]
            packed = piece if k == 0 and streams > 1 else pack(piece)
            packed = piece if len(packed) >= len(piece) else packed
            out += struct.pack("<i", len(packed)) + packed
        blocks.append(out)
    starts, body = [], b""
    for b in blocks:
        starts.append(16 + 4 * len(blocks) + len(body))
        body += b
    flags = (1 if shuffle else 0) | (0 if split else 16) | codec << 5
    held = 16 + 4 * len(blocks) + len(body)
    return struct.pack("<BBBBIII", 2, 1, flags, width, len(raw), block, held) + struct.pack(f"<{len(starts)}i", *starts) + body


@pytest.mark.parametrize("codec", [1, 3, 4])
@pytest.mark.parametrize("width,block,n", [(2, 4096, 5000), (4, 1024, 1024), (8, 2048, 777), (1, 512, 1300), (2, 100, 333)])
def test_blosc_frames(codec, width, block, n):
    raw = (np.arange(n * width) // 7 % 251).astype(np.uint8).tobytes()
    for shuffle in (True, False):
        for split in (True, False):
            assert blosc.decompress(blosc_frame(raw, width, block, codec, shuffle, split)) == raw


def test_blosc_frames_that_have_no_decoder():
    raw = bytes(range(100)) * 10
    frame = blosc_frame(raw, 2, 500)
    assert blosc.decompress(struct.pack("<BBBBIII", 2, 1, 2, 2, len(raw), 500, 16 + len(raw)) + raw) == raw  # stored whole
    for bad in (frame[:10], frame[:-1], frame[:2] + bytes([frame[2] | 4]) + frame[3:], frame[:2] + b"\x01" + frame[3:]):
        with pytest.raises(ValueError):
            blosc.decompress(bad)


def write_store(root, a, chunk, version, codec, skip=(), axes=None, big=False):
    """A store with one level; chunks in ``skip`` have no file."""
    base = root / "0"
    base.mkdir(parents=True)
    kind = a.dtype.newbyteorder(">" if big else "<")
    pack = {"gzip": gzip.compress, "zlib": zlib.compress, "zstd": zstandard.ZstdCompressor().compress, "blosc": lambda b: blosc_frame(b, a.dtype.itemsize, 1024), None: bytes}[codec]
    scales = {"multiscales": [{"axes": [{"name": x} for x in axes or "tczyx"[-a.ndim :]], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1.0] * (a.ndim - 3) + [2.0, 0.5, 0.25]}]}]}]}
    if version == 2:
        (base / ".zarray").write_text(json.dumps({"zarr_format": 2, "shape": a.shape, "chunks": chunk, "dtype": kind.str, "compressor": codec and {"id": codec}, "order": "C", "fill_value": 7}))
        (root / ".zattrs").write_text(json.dumps(scales))
    else:
        codecs = [{"name": "bytes", "configuration": {"endian": "big" if big else "little"}}, *([{"name": codec, "configuration": {}}] if codec else [])]
        (base / "zarr.json").write_text(json.dumps({
            "zarr_format": 3, "node_type": "array", "shape": a.shape, "data_type": a.dtype.name, "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": chunk}},
            "chunk_key_encoding": {"name": "default", "configuration": {"separator": "/"}}, "fill_value": 7, "codecs": codecs,
        }))
        (root / "zarr.json").write_text(json.dumps({"zarr_format": 3, "node_type": "group", "attributes": {"ome": scales}}))
    for place in np.ndindex(*(-(-s // c) for s, c in zip(a.shape, chunk))):
        if place in skip:
            continue
        part = np.zeros(chunk, kind)
        real = a[tuple(slice(p * c, (p + 1) * c) for p, c in zip(place, chunk))]
        part[tuple(slice(0, n) for n in real.shape)] = real
        target = base / (".".join(map(str, place)) if version == 2 else "c/" + "/".join(map(str, place)))
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(pack(part.tobytes()))


def voxels_of(df):
    return {(r.dataset, r.t, r.c, r.z, r.y, r.x): r.value for r in df.collect()}


def plain(a, name):
    b = a.reshape((1,) * (5 - a.ndim) + a.shape) if a.ndim != 4 else a[:, None]
    return {(name, *at): float(b[at]) for at in np.ndindex(b.shape)}


@pytest.mark.parametrize("version,codec,big", [(2, "blosc", False), (2, None, True), (2, "gzip", False), (3, "blosc", False), (3, "zstd", False), (3, None, True)])
@pytest.mark.parametrize("shape,chunk", [((4, 5, 6), (3, 2, 6)), ((2, 3, 5, 4), (1, 2, 3, 4)), ((2, 2, 3, 4, 5), (1, 1, 3, 4, 3))])
def test_stores_become_voxels(spark, tmp_path, version, codec, big, shape, chunk):
    a = (np.arange(np.prod(shape)) * 3 % 1009).astype(np.uint16).reshape(shape)
    write_store(tmp_path / "s.zarr", a, chunk, version, codec, big=big)
    voxels, size = volumes.read_store(spark, f"file://{tmp_path}/s.zarr", dataset="d")
    assert size == (2.0, 0.5, 0.25) and voxels_of(voxels) == plain(a, "d")
    assert voxels_of(volumes.read_array(spark, f"{tmp_path}/s.zarr/0", "e")) == plain(a, "e")


def test_missing_chunks_hold_the_fill_value(spark, tmp_path):
    a = np.arange(2 * 4 * 4, dtype=np.int32).reshape(2, 4, 4)
    write_store(tmp_path / "s.zarr", a, (1, 4, 2), 3, "zstd", skip={(1, 0, 0)})
    lost = {k for k in plain(a, "d") if k[3] == 1 and k[5] < 2}
    path = f"{tmp_path}/s.zarr"
    assert voxels_of(volumes.read_store(spark, path, dataset="d")[0]) == {k: v for k, v in plain(a, "d").items() if k not in lost}
    assert voxels_of(volumes.read_store(spark, path, dataset="d", missing="fill")[0]) == plain(a, "d") | dict.fromkeys(lost, 7.0)


def test_filters_choose_the_chunks(spark, tmp_path):
    """Broken chunks prove what is opened: only those that a filter leaves."""
    a = np.arange(4 * 2 * 3 * 4 * 4).reshape(4, 2, 3, 4, 4).astype(np.float32)
    for name in ("one", "two"):
        write_store(tmp_path / f"{name}.zarr", a, (1, 1, 3, 2, 4), 3, None)
    for broken in ("two.zarr/0/c/0/0/0/0/0", "one.zarr/0/c/3/1/0/0/0", "one.zarr/0/c/2/0/0/1/0"):
        (tmp_path / broken).write_bytes(b"?")
    chunked.register(spark)
    read = lambda where: spark.read.format("chunked_arrays").load(str(tmp_path)).filter(where)
    want = lambda keep: {k: v for n in ("one", "two") for k, v in plain(a, n).items() if keep(*k)}
    for where, keep in (
        ("dataset = 'one' AND t < 2", lambda d, t, c, z, y, x: d == "one" and t < 2),
        ("dataset = 'two' AND t IN (1, 3) AND c = 1 AND x >= 2", lambda d, t, c, z, y, x: d == "two" and t in (1, 3) and c == 1 and x >= 2),
        ("dataset = 'one' AND t = 2 AND y <= 1", lambda d, t, c, z, y, x: d == "one" and t == 2 and y <= 1),
        ("t > 2 AND c = 0 AND value > 300", lambda d, t, c, z, y, x: t > 2 and c == 0 and a[t, c, z, y, x] > 300),
        ("dataset = 'three'", lambda *k: False), ("t = 9", lambda *k: False), ("t = 1 AND t = 3", lambda *k: False),
    ):
        assert voxels_of(read(where)) == want(keep), where
    assert read("dataset = 'one' AND t = 1").rdd.getNumPartitions() == 4
    with pytest.raises(Exception):
        read("dataset = 'one' AND t = 2").collect()


def test_levels_and_faults_of_metadata(spark, tmp_path):
    assert chunked.level_of({}, 2) == ("2", None) and chunked.level_of({"multiscales": 3}) == ("0", None)
    said = {"axes": [{"name": x} for x in "zyx"], "datasets": [{"path": "a", "coordinateTransformations": [{"type": "translation"}, {"type": "scale", "scale": [1, 2, 3]}, {"type": "scale", "scale": [9, 9, 9]}]}, {"path": "b"}]}
    assert chunked.level_of({"multiscales": [said]}) == ("a", (1.0, 2.0, 3.0)) and chunked.level_of({"ome": {"multiscales": [said]}}, 1) == ("b", None)
    assert chunked.level_of({"multiscales": [said]}, 5) == ("5", None)
    with pytest.raises(FileNotFoundError):
        volumes.read_array(spark, str(tmp_path / "nothing"))
    flat = np.arange(6, dtype=np.int16).reshape(2, 3)
    write_store(tmp_path / "flat.zarr", flat[None], (1, 2, 3), 3, None)
    info = json.loads((tmp_path / "flat.zarr/0/zarr.json").read_text())
    for change in ({"codecs": [{"name": "sharding_indexed"}]}, {"shape": [2, 3]}):
        (tmp_path / "flat.zarr/0/zarr.json").write_text(json.dumps(info | change))
        with pytest.raises(Exception):
            volumes.read_array(spark, f"{tmp_path}/flat.zarr/0").collect()


def test_voxels_survive_a_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = {("d" if i % 3 else "e", int(t), int(c), int(z), int(y), int(x)): float(v) for i, (t, c, z, y, x, v) in enumerate(zip(*(rng.integers(0, n, 200) for n in (3, 2, 5, 9, 7)), rng.normal(size=200)))}
    table = spark.createDataFrame([(*k, v) for k, v in data.items()], chunked.VOXELS)
    for _ in range(2):  # written twice: the same files
        chunked.write_voxels(table, str(tmp_path / "v"), (1, 2, 2, 4, 4))
        back = spark.read.format("chunked_arrays").option("missing", "skip").load(str(tmp_path / "v")).filter("NOT isnan(value)")
        assert voxels_of(back) == data


def test_graph_stores(spark, tmp_path):
    n = spark.createDataFrame([("d", i * 3, i % 4, i + 0.5, i / 3, -1.0 * i) for i in range(23)], "dataset string, node_id long, t int, z double, y double, x double")
    e = spark.createDataFrame([("d", 3 * i, 3 * i + 3) for i in range(19)], "dataset string, source long, target long")
    path = str(tmp_path / "g.geff")
    volumes.write_graph(n, e, path, 41.0, chunk=5)
    nodes, edges = volumes.read_graph(spark, path, "d", (2.0, 1.0, 1.0))
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(nodes, n.withColumn("z", F.col("z") * 2)) and same(edges, e) and nodes.rdd.getNumPartitions() == 5
    assert volumes.estimated_nodes(spark, path, nodes) == 41.0
    volumes.write_graph(n, e.limit(0), str(tmp_path / "h.geff"), chunk=7)
    nodes, edges = volumes.read_graph(spark, str(tmp_path / "h.geff"), "d")
    assert edges.count() == 0 and volumes.estimated_nodes(spark, str(tmp_path / "h.geff"), nodes) == 23.0
    # chunks of another length than the ids' chunks, and a missing property
    props = tmp_path / "g.geff" / "nodes" / "props"
    (props / "z" / "values" / "zarr.json").unlink()
    with pytest.raises(Exception, match="no arrays"):
        volumes.read_graph(spark, path, "d")[0].collect()

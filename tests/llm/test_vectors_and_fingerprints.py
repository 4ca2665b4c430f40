"""Whitening against a plain eigendecomposition, fingerprints and their links against all pairs."""

import collections
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cladeframe.llm import queries
from cladeframe.llm import simhash_vptree as sim
from cladeframe.llm import whitening as wh
from tests.llm.conftest import DOCS, SF

VECTORS = "vec_id long, embedding array<float>, n string, whitened long, packed string"


def plain_whitening(vectors, k):
    """By vec_id: n, deviation and |projections|, with explained and eigenvalues by length."""
    spaces = collections.defaultdict(list)
    for i, v in vectors:
        if v and all(x is not None and np.isfinite(x) for x in v):
            spaces[len(v)].append((i, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    rows, explained = [], {}
    for d, members in spaces.items():
        x = np.array([v for _, v in members], object)
        u = np.array(sorted({tuple(v) for v in x.tolist()}), object)
        n, s = len(u), u.sum(axis=0)
        c = (u * n - s).astype(float) / n
        e, w = np.linalg.eigh(c.T @ c / n)
        e, w = e[::-1], w[:, ::-1]
        explained[d] = e / e.sum() if e.sum() > 0 else e
        for (i, v), row in zip(members, x):
            m = row * n - s
            p = np.abs(m.astype(float) / n @ w[:, :k]) / np.sqrt(np.where(e[:k] > 1e-9, e[:k], np.nan))
            rows.append((i, n, int((m * m).sum()), p))
    return rows, explained


def test_whitening_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(wh, "BLOCK_ENTRIES", 40)
    rng = np.random.default_rng(1)
    data = [(i, (rng.normal(size=6) * [3, 2, 1, 1, 0.5, 0.1] + 1000).tolist()) for i in range(200)]
    data += [(500 + i, data[3][1]) for i in range(90)] + [(7, data[8][1]), (None, data[9][1])]
    data += [(900, None), (901, [None] * 6), (902, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (903, [float("nan")] * 6), (904, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (905, [])]
    data += [(1000 + i, [float(i), float(i % 3)]) for i in range(20)]  # another length
    df = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in data], VECTORS).repartition(5)
    got = wh.whiten(df, k=4).collect()
    want, explained = plain_whitening(data, 4)
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    mine = sorted(((r.vec_id, r.n, r.deviation, r.whitened) for r in got), key=key)
    assert [r[:3] for r in mine] == [r[:3] for r in sorted(want, key=key)]
    for a, b in zip(mine, sorted(want, key=key)):
        assert np.allclose(np.abs(a[3]), b[3], atol=1e-8)
    for r in got:
        assert np.allclose(r.explained, explained[6 if len(r.whitened) == 4 else 2][:4]) and r.identity_error < 1e-9
    assert {len(r.whitened) for r in got} == {2, 4}


def test_whitening_without_variance_or_rows(spark):
    same = spark.createDataFrame([(i, [1.5, 2.5]) for i in range(4)], "vec_id long, embedding array<double>")
    rows = wh.by_component(wh.whiten(same)).collect()
    assert len(rows) == 8 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in rows} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    rows = wh.by_component(wh.whiten(line)).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in rows) and all(abs(r.explained - (r.component == 1)) < 1e-12 for r in rows)
    assert wh.by_component(wh.whiten(same.limit(0))).count() == 0


def test_large_and_far_values(spark):
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [-1e30, 2.0]), (2, [5e15 + 3, 1.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in wh.whiten(huge).collect()}
    assert got[0].deviation is None and got[0].n == 3 and np.isfinite(got[2].whitened[0]) and got[2].whitened[1] is None  # lost beside the first
    # an offset of 2^40 steps costs no digits
    rng = np.random.default_rng(3)
    base = rng.integers(-2000, 2000, (300, 5))
    near, far = (spark.createDataFrame([(i, [float(x) / 256 for x in v]) for i, v in enumerate((base + off).tolist())], "vec_id long, embedding array<double>") for off in (0, 1 << 40))
    a, b = ({r.vec_id: (r.deviation, np.abs(r.whitened)) for r in wh.whiten(t).collect()} for t in (near, far))
    assert all(a[i][0] == b[i][0] and np.allclose(a[i][1], b[i][1], atol=1e-11) for i in a)


def test_merging_parts_equals_the_whole():
    rng = np.random.default_rng(5)
    x = rng.integers(-(1 << 40), 1 << 40, (57, 4)) + (1 << 50)
    whole = wh.block_part(x)
    merged = wh.merge(wh.merge(wh.block_part(x[:1]), wh.block_part(x[1:30])), wh.block_part(x[30:]))
    assert merged.n == 57 and merged.sums == whole.sums == [int(s) for s in x.astype(object).sum(axis=0)]
    assert np.allclose(merged.scatter, whole.scatter, rtol=1e-12)


def test_whitening_query_at_the_smallest_scale(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in table.collect()]
    want, explained = plain_whitening(rows, 4)
    got = {(r.vec_id, r.component): r for r in queries.op11_embedding_whitening(spark, SF).collect()}
    assert len(got) == 4 * len(want)
    for i, n, deviation, p in want:
        for k in range(4):
            r = got[i, k + 1]
            assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - p[k]) < 1e-9 and abs(r.explained - explained[64][k]) < 1e-9


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(bits, radius=2):
    """The smallest place reachable, by all pairs."""
    seen = np.full(len(bits), -1)
    for i in range(len(bits)):
        if seen[i] < 0:
            open_ = [i]
            seen[i] = i
            while open_:
                near = np.flatnonzero((np.bitwise_count(bits ^ bits[open_.pop()]) <= radius) & (seen < 0))
                seen[near] = i
                open_ += near.tolist()
    return seen


def check_against_all_pairs(rows, got):
    named = {}
    bits = np.array(sorted({plain_fingerprint(t) for _, t in rows}), np.uint64)
    for place, root in enumerate(plain_components(bits)):
        named[int(bits[place])] = root
    lows = {}
    for i, t in rows:
        root = named[plain_fingerprint(t)]
        lows[root] = min((x for x in (lows.get(root), i) if x is not None), default=None)
    want = sorted(((i, f"{plain_fingerprint(t):016x}", lows[named[plain_fingerprint(t)]]) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got.collect()), key=repr) == want


def digits(df):
    return df.select("doc_id", sim.hex_digits("bits").alias("fingerprint"), "component_id")


def test_near_copies_of_odd_documents(spark, docs, odd_docs, empty_docs, monkeypatch):
    from tests.llm.conftest import make_docs

    rows = [(r[0], r[1]) for r in make_docs()]
    check_against_all_pairs(rows, digits(sim.near_duplicates(odd_docs)))
    for name, value in (("SHARD_AIM", 4), ("LEAF_SAMPLE", 40), ("SMALL", 4), ("STRIPE", 3), ("HOT_SHARE", 0.03), ("SLICE", 7), ("HELD_LINKS", 2)):
        monkeypatch.setattr(sim, name, value)
    check_against_all_pairs(rows, digits(sim.near_duplicates(docs)))
    monkeypatch.setattr(sim, "SHARD_ROWS", 5)  # shards in pairs of parts
    check_against_all_pairs(rows, digits(sim.near_duplicates(docs)))
    assert sim.near_duplicates(empty_docs).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d", None, None, None)] * 2 + [(None, "x y z w", None, None, None)], DOCS)
    assert {r.component_id for r in sim.near_duplicates(nameless).collect()} == {None}


def test_near_copies_query_at_the_smallest_scale(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_against_all_pairs(rows, queries.op12_simhash_near_copies(spark, SF))


@pytest.mark.parametrize("soft", [3, 9, 14, 64])
def test_links_inside_a_shard_equal_all_pairs(soft, monkeypatch):
    """Points around few centres, with ``soft`` bits that vary: from one ball to no neighbours at all."""
    monkeypatch.setattr(sim, "SMALL", 24)
    monkeypatch.setattr(sim, "HELD_LINKS", 50)
    rng = np.random.default_rng(soft)
    centres = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
    noise = rng.integers(0, 1 << 63, 1500, dtype=np.uint64) & np.uint64((1 << min(soft, 63)) - 1)
    points = np.unique(centres[rng.integers(0, 5, 1500)] ^ noise)
    assert np.array_equal(sim.linked(points), plain_components(points))


def test_every_link_is_whole_in_one_shard():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    one, two = (np.uint64(1) << rng.integers(0, 63, 3000, dtype=np.uint64) for _ in range(2))
    points = np.concatenate([base, base ^ one ^ two])
    nodes = sim.grow(np.sort(rng.choice(points, 512)), 3, 2)
    assert sum(len(n) == 1 for n in nodes) == 8
    batch = pa.RecordBatch.from_arrays([pa.array(points.view(np.int64))], names=["bits"])
    homes = collections.defaultdict(set)
    for out in sim._routed(nodes, 2)(iter([batch])):
        for s, b in zip(out.column("shard").to_pylist(), out.column("bits").to_pylist()):
            homes[b].add(s)
    signed = points.view(np.int64).tolist()
    assert all(homes[a] & homes[b] for a, b in zip(signed[:3000], signed[3000:]))
    assert sum(map(len, homes.values())) < 3 * len(homes)


def test_native_hash_gives_the_same_fingerprints(spark):
    texts = ["The river  HOUSE", "a b", "ä ö ü", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    native = df.select(F.xxhash64(F.regexp_replace(F.lower("text"), " +", " ")).alias("h")).collect()
    assert [r.h & (1 << 64) - 1 for r in native] == [plain_fingerprint(t) for t in texts]

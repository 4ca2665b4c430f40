"""Operators of the engine: hand-made cases with exact counts, and random ones against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import assign as S
from cladeframe.operators import ensemble as C
from cladeframe.operators import evaluation as E
from cladeframe.operators import graph as G
from cladeframe.operators import image as I
from cladeframe.operators import metrics as M
from cladeframe.operators import repair as R
from cladeframe.operators import track as K
from cladeframe.sources import submission as U

NODE = "dataset string, node_id long, t int, z double, y double, x double"
EDGE = "dataset string, source long, target long"


def nodes(spark, *rows):
    return spark.createDataFrame([("d", i, t, float(z), float(y), float(x)) for i, t, z, y, x in rows], NODE)


def edges(spark, *rows):
    return spark.createDataFrame([("d", a, b) for a, b in rows], EDGE)


def pairs(df):
    return sorted((r.source, r.target) for r in df.collect())


def test_least_cost_matches_permutations():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(1, 6, 2)
        cost = rng.integers(0, 20, (n, m)).astype(float)
        got = S.least_cost(cost)
        small, large = int(min(n, m)), int(max(n, m))
        c = cost if n <= m else cost.T
        best = min(sum(c[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))
        assert len(got) == small and len({a for a, _ in got}) == len({b for _, b in got}) == small
        assert sum(cost[a, b] for a, b in got) == pytest.approx(best)


def test_best_pairs_maximises_pairs_first():
    rng = random.Random(1)
    for _ in range(200):
        cand = [(a, b, float(rng.randint(0, 9))) for a in range(4) for b in range(4) if rng.random() < 0.5]
        got = S.best_pairs([c[0] for c in cand], [c[1] for c in cand], [c[2] for c in cand])
        best = (0, 0.0)
        for k in range(len(cand) + 1):
            for pick in itertools.combinations(cand, k) if k <= 4 else ():
                if len({p[0] for p in pick}) == len({p[1] for p in pick}) == k:
                    best = max(best, (k, -sum(p[2] for p in pick)))
        assert (len(got), -sum(cand[i][2] for i in got)) == best


def test_largest_matching_size():
    rng = random.Random(2)
    for _ in range(100):
        cand = [(a, 10 + b) for a in range(5) for b in range(5) if rng.random() < 0.35]
        best = max((k for k in range(6) for pick in itertools.combinations(cand, k) if len({p[0] for p in pick}) == len({p[1] for p in pick}) == k), default=0)
        got = S.largest_matching(cand)
        assert len(got) == best and len(set(got.values())) == best


def test_contested_pairs_of_a_large_frame():
    rng = np.random.default_rng(9)
    n = 3000
    left, right, cost = [], [], []
    for i in range(n):
        for j in {i, (i + 1) % n, *rng.integers(max(0, i - 5), min(n, i + 5), 3).tolist()}:
            left.append(i)
            right.append(j)
            cost.append(float(rng.random()))
    got = S.best_pairs(left, right, cost)
    assert len(got) == n and len({left[k] for k in got}) == len({right[k] for k in got}) == n


def test_least_cost_graph_matches_all_subsets():
    from cladeframe.operators import flow as W

    rng = random.Random(11)
    for _ in range(120):
        at = {v: rng.randrange(4) for v in range(6)}
        cand = [(a, at[a], b, at[b], -rng.random()) for a in at for b in at if at[b] == at[a] + 1 and rng.random() < 0.8][:9]
        appear, vanish = rng.choice([(0.1, 0.1), (0.3, 0.05), (0.0, 0.2)])
        divide = appear + rng.choice([0.0, 0.2, 0.9])

        def price(pick):
            kids, parents = {}, {}
            for s, _, t, _, c in pick:
                kids[s], parents[t] = kids.get(s, 0) + 1, parents.get(t, 0) + 1
            if max(kids.values(), default=0) > 2 or max(parents.values(), default=0) > 1:
                return float("inf")
            used = {*kids, *parents}
            return sum(p[4] for p in pick) + appear * len(used - set(parents)) + vanish * len(used - set(kids)) + divide * sum(k == 2 for k in kids.values())

        best = min(price([cand[i] for i in range(len(cand)) if m >> i & 1]) for m in range(1 << len(cand)))
        found = [cand[i] for i in W.cheapest_edges(cand, appear, vanish, divide)] if cand else []
        assert price(found) == pytest.approx(best)


@pytest.mark.parametrize("few", [1, 8])
def test_least_cost_graph_of_few_candidates_is_that_of_all(spark, monkeypatch, few):
    from cladeframe.operators import flow as W

    rng = random.Random(5)
    at = {v: v // 15 for v in range(60)}
    rows = [("d", a, b, rng.choice([0.3, 0.7, 0.8, 0.95, 1.0])) for a in at for b in at if at[b] == at[a] + 1]
    n = spark.createDataFrame([("d", v, t) for v, t in at.items()], "dataset string, node_id bigint, t int")
    monkeypatch.setattr(W, "FEW_EDGES", few)
    kept, got = W.solve(n, spark.createDataFrame(rows, "dataset string, source bigint, target bigint, probability double"))

    def price(picked):
        s, t = [r[1] for r in picked], [r[2] for r in picked]
        used = {*s, *t}
        return sum(-r[3] for r in picked) + 0.1 * (len(used - set(t)) + len(used - set(s))) + sum(s.count(v) - 1 for v in set(s)), used

    all_rows = [rows[i] for i in W.cheapest_edges([(a, at[a], b, at[b], -p) for _, a, b, p in rows], 0.1, 0.1, 1.0)]
    cost, used = price([tuple(r) for r in got.collect()])
    assert cost == pytest.approx(price(all_rows)[0]) and {r.node_id for r in kept.collect()} == used


def test_pool_points_bridge_a_whole_chain_only(spark):
    # two ends compete for one start; only the farther one has a pool point on its way
    n = nodes(spark, (1, 0, 0, 0, 0), (2, 0, 0, 6, 0), (3, 2, 0, 2, 0))
    none = edges(spark, (90, 91)).limit(0)
    pool = nodes(spark, (7, 1, 0, 4.2, 0)).withColumn("score", F.lit(0.9))
    got_n, got_e = R.fill_from_pool(n, none, pool, 1, 0.5, 5.0, 0.5, 1.0)
    assert pairs(got_e) == [(2, 4), (4, 3)] and got_n.filter("node_id = 4").first().y == 4.2
    got_n, got_e = R.fill_from_pool(n, none, pool, 1, 0.5, 5.0, 0.5, 1.0, synthetic=1)
    assert pairs(got_e) == [(1, 4), (4, 3)] and got_n.filter("node_id = 4").first().y == 1.0  # nearer, and a point on the line is allowed
    assert R.fill_from_pool(n, none, pool, 1, 0.5, 5.0, 0.5, 0.0)[1].count() == 0  # no room
    turn = nodes(spark, (1, 0, 0, 0, 0), (2, 1, 0, 0, 2), (3, 3, 0, 0, 0))
    back = nodes(spark, (7, 2, 0, 0, 1)).withColumn("score", F.lit(0.9))
    assert R.fill_from_pool(turn, edges(spark, (1, 2)), back, 1, 0.5, 5.0, 3.5, 1.0)[1].count() == 1
    assert R.fill_from_pool(turn, edges(spark, (1, 2)), back, 1, 0.5, 5.0, 3.5, 1.0, direction=False)[1].count() == 3


def test_hooks_take_part(spark):
    from cladeframe.operators import hooks as H

    n = nodes(spark, (1, 0, 0, 0, 0), (2, 2, 0, 0, 4))
    none = edges(spark, (90, 91)).limit(0)
    up, _ = R.close_gaps(n, none, 12.0, 2.0, score=lambda p: p.withColumn("confidence", F.lit(0.5)), refine=lambda m: m.withColumn("z", F.col("z") + 9))
    assert up.filter("node_id = 3").first().z == 9.0
    with pytest.raises(ValueError):
        R.close_gaps(n, none, 12.0, 2.0, score=lambda p: p)
    cand = spark.createDataFrame([("d", 1, 2)], EDGE)
    assert H.scored(cand, lambda c: c.withColumn("probability", F.lit(0.25))).first().probability == 0.25
    with pytest.raises(Exception):
        H.scored(cand, lambda c: c.withColumn("probability", F.lit(2.0))).collect()


def test_link_divisions(spark):
    n = nodes(spark, (1, 0, 0, 0, 0), (2, 1, 0, 0, 1), (3, 1, 0, 1, 0))
    assert pairs(K.link(n, 5, 5)) == [(1, 2), (1, 3)]
    three = nodes(spark, (1, 0, 0, 0, 0), (2, 1, 0, 0, 1), (3, 1, 0, 2, 0), (4, 1, 3, 0, 0))
    assert len(pairs(K.link(three, 5, 5))) == 2
    far = nodes(spark, (1, 0, 0, 0, 0), (2, 1, 0, 0, 1), (3, 1, 0, 4, 0))
    assert pairs(K.link(far, 5, 5, tau=0.6)) == [(1, 2)] and len(pairs(K.link(far, 5, 5))) == 2
    gap = nodes(spark, (1, 0, 0, 0, 0), (2, 3, 0, 0, 1))
    assert pairs(K.link(gap)) == [(1, 2)]


def test_velocity_keeps_crossing_tracks_apart(spark):
    n = nodes(spark, (1, 0, 0, 0, 0), (2, 1, 0, 0, 2), (3, 2, 0, 0, 4), (11, 0, 0, 0, 5), (12, 1, 0, 0, 3), (13, 2, 0, 0, 1))
    assert pairs(K.track(n, alpha=1.0)) == [(1, 2), (2, 3), (11, 12), (12, 13)]
    assert (2, 13) in pairs(K.link(n))


def test_relink_prefers_the_predicted_position(spark):
    n = nodes(spark, (1, 0, 0, 0, 0), (2, 1, 0, 0, 5), (3, 2, 0, 0, 6), (4, 2, 0, 0, 9))
    assert pairs(K.relink(n, tight=6.0, relaxed=10.0, velocity_weight=1.0)) == [(1, 2), (2, 4)]
    assert pairs(K.relink(nodes(spark, (1, 0, 0, 0, 0), (2, 2, 0, 0, 1)))) == []
    assert pairs(K.relink(n, max_frame=1)) == []
    prob = spark.createDataFrame([("d", 2, 3, 1.0)], EDGE + ", probability double")
    assert (2, 3) in pairs(K.relink(n, prob, velocity_weight=1.0, bonus=10.0))


def test_close_gaps_reuses_or_makes_nodes(spark):
    n = nodes(spark, (1, 0, 0, 0, 0), (2, 2, 0, 0, 4), (3, 1, 0, 0, 2.5), (4, 0, 50, 0, 0), (5, 2, 50, 0, 4))
    got_n, got_e = R.close_gaps(n, edges(spark, (90, 91)).limit(0), 12.0, 2.0)
    made = [r for r in got_n.collect() if r.node_id > 5]
    assert len(made) == 1 and (made[0].t, made[0].z, made[0].x) == (1, 50.0, 2.0) and made[0].node_id in (6, 7)
    assert pairs(got_e) == sorted([(1, 3), (3, 2), (4, made[0].node_id), (made[0].node_id, 5)])


def score(spark, pn, pe, tn, te, gate=7.0):
    p, t = nodes(spark, *pn), nodes(spark, *tn)
    e, g = edges(spark, *pe), edges(spark, *te)
    m = S.match_nodes(p, t, gate).select("dataset", "pred_id", "gt_id")
    return M.edge_confusion(e, g, m).first(), M.division_confusion(p, e, t, g, m).first()


TRUTH = [(1, 0, 0, 0, 0), (2, 1, 0, 0, 1), (3, 1, 0, 0, -1), (4, 2, 0, 0, 20), (5, 2, 0, 0, -20)]
LINKS = [(1, 2), (1, 3), (2, 4), (3, 5)]


def test_perfect_graph(spark):
    e, d = score(spark, TRUTH, LINKS, TRUTH, LINKS)
    assert tuple(e)[1:] == (4, 0, 0) and tuple(d)[1:] == (1, 0, 0)


def test_late_fork_counts_and_far_fork_does_not(spark):
    late = [(1, 0, 0, 0, 0), (6, 1, 0, 0, 300), (4, 2, 0, 0, 20), (5, 2, 0, 0, -20)]
    _, d = score(spark, late, [(1, 6), (6, 4), (6, 5)], TRUTH, LINKS)
    assert (d.division_tp, d.division_fn) == (1, 0)
    far = [(i + 100, t, z + 500, y, x) for i, t, z, y, x in TRUTH[:3]]
    _, d = score(spark, far, [(101, 102), (101, 103)], [(1, 0, 0, 0, 0), (2, 1, 0, 0, 1)], [(1, 2)])
    assert tuple(d)[1:] == (0, 0, 0)
    _, d = score(spark, [(1, 0, 0, 0, 0), (2, 1, 0, 0, 1), (3, 1, 0, 0, 3)], [(1, 2), (1, 3)], [(1, 0, 0, 0, 0), (2, 1, 0, 0, 1)], [(1, 2)])
    assert (d.division_tp, d.division_fp) == (0, 1)


def test_unmatched_edges_are_ignored(spark):
    e, _ = score(spark, [(1, 0, 0, 0, 0), (2, 1, 0, 0, 1), (8, 0, 50, 50, 50), (9, 1, 50, 50, 51)], [(1, 2), (8, 9)], [(1, 0, 0, 0, 0), (2, 1, 0, 0, 1)], [(1, 2)])
    assert tuple(e)[1:] == (1, 0, 0)


def test_consensus_resolves_contested_edges(spark):
    a = nodes(spark, (1, 0, 0, 0, 0), (2, 1, 0, 0, 1)), edges(spark, (1, 2))
    b = nodes(spark, (1, 0, 0, 0, 1), (2, 1, 0, 0, 2), (3, 1, 0, 0, 9)), edges(spark, (1, 2), (1, 3))
    n, e = C.consensus([a, b], 3.5, 2, 1)
    assert n.count() == 2 and e.count() == 1 and n.filter("t = 0").first().x == 0.5
    n, e = C.consensus([a, b], 3.5, 1, 1)
    assert n.count() == 3 and e.count() == 2  # one graph has a fork there
    assert C.consensus([a, b], 3.5, 1, 2)[1].count() == 1


def test_components_match_union_find(spark):
    rng = random.Random(4)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    lead = list(range(200))

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        lead[max(x, y)] = min(x, y)
    n = nodes(spark, *((i, 0, 0, 0, 0) for i in range(200)))
    got = {r.node_id: r.component for r in G.components(n, edges(spark, *links)).collect()}
    assert got == {i: top(i) for i in range(200)}


def test_suppression_and_centroid(spark):
    peaks = spark.createDataFrame([(0, 0, 0, 0, 9.0), (0, 0, 0, 1, 8.0), (0, 0, 0, 3, 7.0)], "t int, z int, y int, x int, value double")
    assert sorted(r.x for r in I.suppress(peaks, 2.0).collect()) == [0, 3]
    grid = [(0, z, y, x, 0.0) for z in range(3) for y in range(3) for x in range(3)]
    grid = [(t, z, y, x, 1.0 if (z, y, x) == (1, 1, 1) else 3.0 if (z, y, x) == (1, 1, 2) else v) for t, z, y, x, v in grid]
    v = spark.createDataFrame(grid, "t int, z int, y int, x int, value double")
    c = I.centroids(spark.createDataFrame([(0, 1, 1, 1)], "t int, z int, y int, x int"), v, (1, 1, 1)).first()
    assert (c.cz, c.cy, c.cx) == (1.0, 1.0, 1.75)


def test_frames_of_several_datasets_and_channels_do_not_mix(spark):
    one = [(d, c, 0, z, y, x, float(v)) for d, c, v in (("a", 0, 9), ("a", 1, 1), ("b", 0, 5)) for z in range(2) for y in range(3) for x in range(3)]
    one = [(*r[:6], r[6] + 1.0) if r[3:6] == (1, 1, 1) else r for r in one]
    v = spark.createDataFrame(one, "dataset string, c int, t int, z int, y int, x int, value double")
    assert sorted((r.dataset, r.c, r.value) for r in I.peaks(v, 1.5).collect()) == [("a", 0, 10.0), ("a", 1, 2.0), ("b", 0, 6.0)]
    assert {(r.dataset, r.c): r.value for r in I.normalize(v).filter("z = 1 AND y = 1 AND x = 1").collect()} == {("a", 0): 1.0, ("a", 1): 1.0, ("b", 0): 1.0}


def test_blob_response_on_coarse_planes(spark):
    at = np.indices((9, 15, 15)).reshape(3, -1).T
    value = 10 * np.exp(-(((at - (4, 7, 7)) * (2.0, 1.0, 1.0)) ** 2).sum(1) / 8)
    df = spark.createDataFrame([(0, *map(int, p), float(x)) for p, x in zip(at, value)], "t int, z int, y int, x int, value double")
    found = I.peaks(I.blob_response(df, [1.5, 2.0], 1.6, (2.0, 1.0, 1.0)), 0.1)
    assert [(r.z, r.y, r.x) for r in found.collect()] == [(4, 7, 7)]


def test_segments_part_touching_cells(spark):
    at = np.indices((7, 16, 30)).reshape(3, -1).T
    value = np.zeros(len(at))
    for c in ((3, 8, 8), (3, 8, 17)):
        value += np.exp(-((at - c) ** 2).sum(1) / 9.0)
    df = spark.createDataFrame([("a", 0, *map(int, p), float(x)) for p, x in zip(at, value)], "dataset string, t int, z int, y int, x int, value double")
    out = {(r.z, r.y, r.x): r.label for r in I.segment(df, 7.0).collect()}
    assert out[3, 8, 8] and out[3, 8, 17] and out[3, 8, 8] != out[3, 8, 17] and out[0, 0, 0] == 0 and len(set(out.values())) == 3
    assert {r.label for r in I.segment(df.withColumn("value", F.lit(1.0)), 7.0).collect()} == {0}


def test_numbering_runs_through_all_datasets(spark):
    rows = [("b", "node", 2, 0, 0.5, 1.5, -3.0, -1, -1), ("a", "edge", -1, -1, -1.0, -1.0, -1.0, 1, 9), ("a", "node", 9, 0, 0.0, 0.0, 2.5, -1, -1), ("a", "node", 1, 3, 0.0, 0.0, 0.0, -1, -1)]
    schema = "dataset string, row_type string, node_id long, t long, z double, y double, x double, source_id long, target_id long"
    got = [(r.id, r.dataset, r.row_type, r.node_id, r.z, r.y, r.x) for r in U.numbered(spark.createDataFrame(rows, schema).repartition(3)).orderBy("id").collect()]
    assert got == [(0, "a", "node", 1, 0, 0, 0), (1, "a", "node", 9, 0, 0, 2), (2, "a", "edge", -1, -1, -1, -1), (3, "b", "node", 2, 0, 2, 0)]
    with pytest.raises(ValueError):
        U.numbered(spark.createDataFrame([*rows, ("b", "edge", -1, -1, -1.0, -1.0, -1.0, 2, 9)], schema))


def test_directory_digest_and_log(spark, tmp_path):
    import hashlib

    (tmp_path / "d" / "sub").mkdir(parents=True)
    files = {"a b.txt": b"one", "sub/z": b"", "b": b"three"}
    for name, content in files.items():
        (tmp_path / "d" / name).write_bytes(content)
    want = hashlib.sha256(b"head")
    for name in sorted(files):
        want.update(len(name).to_bytes(8, "big") + name.encode() + len(files[name]).to_bytes(8, "big") + files[name])
    assert U.directory_digest(spark, f"file://{tmp_path}/d", b"head") == want.hexdigest()
    with pytest.raises(ValueError):
        U.log_rows(spark.createDataFrame([("x", 1.0)], "candidate string, score double"))


def test_arrays_of_chunks_become_voxels(spark, tmp_path):
    import json
    import zlib

    from cladeframe.sources import volumes as V

    a = np.arange(2 * 3 * 5 * 4, dtype="<u2").reshape(2, 3, 5, 4)
    root = tmp_path / "s" / "0"
    root.mkdir(parents=True)
    (root / ".zarray").write_text(json.dumps({"shape": a.shape, "chunks": [1, 2, 3, 4], "dtype": "<u2", "compressor": {"id": "zlib"}, "order": "C", "dimension_separator": "/", "zarr_format": 2}))
    (tmp_path / "s" / ".zattrs").write_text(json.dumps({"multiscales": [{"axes": [{"name": x} for x in "tzyx"], "datasets": [{"path": "0", "coordinateTransformations": [{"type": "scale", "scale": [1, 2.0, 0.5, 0.5]}]}]}]}))
    for t in range(2):
        for z in range(2):
            for y in range(2):
                part = np.zeros((1, 2, 3, 4), "<u2")
                real = a[t : t + 1, 2 * z : 2 * z + 2, 3 * y : 3 * y + 3]
                part[:, : real.shape[1], : real.shape[2]] = real
                (root / str(t) / str(z) / str(y)).mkdir(parents=True)
                (root / str(t) / str(z) / str(y) / "0").write_bytes(zlib.compress(part.tobytes()))
    voxels, size = V.read_store(spark, f"file://{tmp_path}/s", dataset="d")
    got = {(r.t, r.c, r.z, r.y, r.x): r.value for r in voxels.collect()}
    assert size == (2.0, 0.5, 0.5) and got == {(t, 0, z, y, x): float(a[t, z, y, x]) for t, z, y, x in np.ndindex(a.shape)}
    assert V.level_of({}, 2) == ("2", None) and V.level_of({"multiscales": [{"datasets": [{"path": "p"}]}]}) == ("p", None)
    flat = V.expanded(spark.createDataFrame([(1, 2, 3, 4.0)], "z int, y int, x int, value double"), "e").first()
    assert tuple(flat) == ("e", 0, 0, 1, 2, 3, 4.0)


def test_curves_and_empty_start(spark):
    rows = spark.createDataFrame([(e, "c", f, e / 10 + (f == "B")) for e in range(3) for f in "AB"], "epoch int, checkpoint string, fold string, score double")
    drawn = E.curves_svg(rows)
    assert drawn.count("<polyline") == 3 and ">mean<" in drawn
    with pytest.raises(ValueError):
        E.curves_svg(rows.filter("fold = 'A' OR epoch > 0"))
    n = nodes(spark, (1, 0, 0, 0, 0))
    assert [tuple(r) for r in E.empty_start(n, ["x", "d"]).orderBy("dataset").collect()] == [("d", 1), ("x", 0)]
    with pytest.raises(RuntimeError):
        E.empty_start(n, ["x", "y", "z", "d"])


def test_missing_error_vectors_are_an_error(spark):
    scores = spark.createDataFrame([("a", 1, 0.9), ("b", 1, 0.9), ("c", 1, 0.9)], "checkpoint string, epoch int, score double")
    errors = spark.createDataFrame([(c, s, e) for c, es in (("a", (0.0, 1.0, 2.0)), ("b", (0.0, 1.0, 2.1)), ("c", (2.0, 1.0, 0.0))) for s, e in enumerate(es)], "checkpoint string, sample int, error double")
    assert [r.checkpoint for r in E.complementary(scores, errors, 2).orderBy("rank").collect()] == ["a", "c"]
    for broken in (errors.filter("checkpoint <> 'b'"), errors.filter("checkpoint <> 'b' OR sample > 0"), errors.withColumn("error", F.when(F.col("sample") > 0, F.col("error")))):
        with pytest.raises(ValueError):
            E.complementary(scores, broken, 2)


def test_gates():
    assert E.ensemble_gate(0.9, 0.903, 1, 2)[0] and not E.ensemble_gate(0.9, 0.9, 1, 2)[0] and not E.ensemble_gate(0.9, 0.95, 3, 2)[0]
    assert E.sweep_choice({"a": 0.5, "b": 0.5003}, "a") == "a" and E.sweep_choice({"a": 0.5, "b": 0.6}, "a") == "b"


def test_temperature_recovers_the_true_one(spark):
    rng = np.random.default_rng(3)
    logit = rng.normal(size=4000) * 2
    label = (rng.random(4000) < 1 / (1 + np.exp(-logit))).astype(int)
    df = spark.createDataFrame([(float(1 / (1 + np.exp(-2 * x))), int(y)) for x, y in zip(logit, label)], "p double, y int").cache()
    assert E.fit_temperature(df, "p", "y") == pytest.approx(2.0, rel=0.15)


@pytest.mark.parametrize("rule", ["duplicate_node", "node_sentinel", "dangling_edge", "not_finite", "row_type", "edge_sentinel", "not_next_frame"])
def test_submission_rules(spark, rule):
    good = [("d", "node", 1, 0, 0.0, 0.0, 0.0, -1, -1), ("d", "node", 2, 1, 0.0, 0.0, 0.0, -1, -1), ("d", "edge", -1, -1, -1.0, -1.0, -1.0, 1, 2)]
    bad = {
        "duplicate_node": ("d", "node", 1, 0, 0.0, 0.0, 0.0, -1, -1), "node_sentinel": ("d", "node", 3, 0, 0.0, 0.0, 0.0, 5, -1), "dangling_edge": ("d", "edge", -1, -1, -1.0, -1.0, -1.0, 1, 99),
        "not_finite": ("d", "node", 3, 0, float("nan"), 0.0, 0.0, -1, -1), "row_type": ("d", "blob", -1, -1, -1.0, -1.0, -1.0, -1, -1), "edge_sentinel": ("d", "edge", 4, -1, -1.0, -1.0, -1.0, 1, 2),
        "not_next_frame": ("d", "edge", -1, -1, -1.0, -1.0, -1.0, 2, 1),
    }[rule]
    schema = "dataset string, row_type string, node_id long, t long, z double, y double, x double, source_id long, target_id long"
    assert U.violations(spark.createDataFrame(good, schema), True).count() == 0
    found = {r.rule for r in U.violations(spark.createDataFrame([*good, bad], schema), True).collect()}
    assert rule in found
    if rule != "not_next_frame":
        with pytest.raises(ValueError):
            U.to_graph(spark.createDataFrame([*good, bad], schema))


def test_stream_links_as_the_batch_does(spark, tmp_path):
    from cladeframe.streaming.linker import link_frames, link_stream

    rng = np.random.default_rng(6)
    rows = [(t, 100 * t + i, *map(float, rng.uniform(0, 60, 3))) for t in range(5) for i in range(12)]
    batch = pairs(K.link(nodes(spark, *((i, t, z, y, x) for t, i, z, y, x in rows))))
    state, got = [], []
    for t in range(6):
        links, state = link_frames(state + [r for r in rows if r[0] == t], 15.0, 20.0, 2, t if t < 5 else 9)
        got += [(a, b) for a, b, *_ in links]
    assert sorted(got) == batch
    df = spark.createDataFrame([("d", i, t, z, y, x) for t, i, z, y, x in rows], NODE).withColumn("ts", F.timestamp_seconds(F.col("t") * 60 + 1_700_000_000))
    for t in range(5):
        df.filter(f"t = {t}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = link_stream(source).writeStream.format("memory").queryName("links").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    streamed = {(r.source, r.target) for r in spark.table("links").collect()}
    assert streamed <= set(batch) and streamed >= {p for p in batch if p[1] < 300}


def test_manifests_and_configs(spark):
    from cladeframe.sources import manifests as X

    assert X.dataset_stem("44b6_a.zarr") == "44b6_a"
    for bad in ("", "a/b", "..", " a", "a\\b", None, ".zarr"):
        with pytest.raises(ValueError):
            X.dataset_stem(bad)
    assert X.load_config('{"tracking": {"max_daughters": 3}}').tracking.max_daughters == 3
    for bad in ('{"x": {}}', '{"tracking": {"y": 1}}', '{"tracking": {"max_daughters": 1}}', '{"gates": {"evaluation_epochs": [5, 5]}}'):
        with pytest.raises(ValueError):
            X.load_config(bad)
    m = X.run_manifest("run1", b"c", b"s", "A", 0, 1.0, "x")
    assert X.manifest_problems(m, b"c", b"s", "run1") == [] and X.manifest_problems(m, b"d", b"s", "run2") == ["config", "candidate"]
    runs = spark.createDataFrame([("r1", "h1"), ("r2", "h2")], "run string, config string")
    results = spark.createDataFrame([("r1", "h1"), ("r2", "hx"), ("r3", "h3")], "run string, config string")
    assert sorted(map(tuple, X.unbound(runs, results, ["config"]).collect())) == [("r2", "config"), ("r3", "run")]


def test_registered_queries_have_sql_or_a_reason():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 120

"""Greedy steps in rounds against the same steps one after another."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladeframe.operators import assign as S
from cladeframe.operators import ensemble as C
from cladeframe.operators import image as I
from cladeframe.operators import repair as R


@pytest.mark.parametrize("kind", ["values", "plateau", "chain"])
def test_suppression_equals_the_sequence(spark, kind):
    rng = np.random.default_rng(2)
    rows = []
    for d in ("a", "b"):
        for t in range(2):
            if kind == "chain":  # each beats the next
                rows += [(d, t, 0, 0, x, float(100 - x)) for x in range(25)]
            else:
                at = {tuple(map(int, v)) for v in rng.integers(0, 12, (160, 3))}
                rows += [(d, t, *v, 5.0 if kind == "plateau" else float(rng.integers(0, 60))) for v in sorted(at)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "dataset string, t int, z int, y int, x int, value double")
    scale, distance = (2.0, 1.0, 1.0), 3.0
    want = set()
    for f in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == f), key=lambda r: (-r[5], r[2:5])):
            if all(np.sqrt(sum(((a - b) * s) ** 2 for a, b, s in zip(r[2:5], k[2:5], scale))) >= distance for k in kept):
                kept.append(r)
        want |= set(kept)
    assert {tuple(r) for r in I.suppress(df, distance, scale).collect()} == want
    assert I.suppress(df, 0.0).count() == len(rows) and I.suppress(df.limit(0), 2.0).count() == 0


def sequence(rows, order, ends):
    """Row numbers taken one after another; ends(row) gives (end, room)."""
    used, out = {}, []
    for i in sorted(range(len(rows)), key=lambda i: order(rows[i])):
        if all(used.get(e, 0) < room for e, room in ends(rows[i])):
            for e, _ in ends(rows[i]):
                used[e] = used.get(e, 0) + 1
            out.append(i)
    return out


@pytest.mark.parametrize("rooms", [(1, 1), (2, 1), (3, 2)])
def test_rows_taken_in_rounds_equal_the_sequence(spark, rooms):
    rnd = random.Random(sum(rooms))
    rows = [(rnd.choice("de"), rnd.randrange(30), rnd.randrange(25), float(rnd.randrange(12)), i) for i in range(400)]
    df = spark.createDataFrame(rows, "dataset string, a long, b long, cost double, i long")
    got = {r.i for r in S.first_come(df, [F.col("cost"), F.col("i")], [("a", "a", rooms[0]), ("b", "b", rooms[1])]).collect()}
    assert got == set(sequence(rows, lambda r: (r[3], r[4]), lambda r: [((r[0], "a", r[1]), rooms[0]), ((r[0], "b", r[2]), rooms[1])]))
    assert {r.i for r in S.greedy(df, ["cost", "i"], "a", "b", *rooms).collect()} == got
    # one role for both ends: a node is used once, whichever end it is
    got = {r.i for r in S.first_come(df.filter("a <> b"), [F.col("cost"), F.col("i")], [("n", "a", 1), ("n", "b", 1)]).collect()}
    some = [r for r in rows if r[1] != r[2]]
    assert got == {some[i][4] for i in sequence(some, lambda r: (r[3], r[4]), lambda r: [((r[0], r[1]), 1), ((r[0], r[2]), 1)])}
    assert S.first_come(df.limit(0), [F.col("cost")], [("a", "a", 1)]).count() == 0


def test_gaps_closed_in_rounds_equal_the_sequence(spark):
    rnd = random.Random(9)
    points = [("d" if i % 2 else "e", i, rnd.randrange(5), *(float(rnd.randrange(14)) for _ in range(3))) for i in range(150)]
    nodes = spark.createDataFrame(points, "dataset string, node_id long, t int, z double, y double, x double")
    edges = spark.createDataFrame([], "dataset string, source long, target long")
    gate, reuse, most = 6.0, 2.0, 25
    got_n, got_e = R.close_gaps(nodes, edges, gate, reuse, max_pairs=most)
    at = {p[1]: p for p in points}
    gap = lambda p, q: sum((a - b) ** 2 for a, b in zip(p, q)) ** 0.5
    links, places = set(), set()
    for d in "de":
        props = [(gap(a[3:], b[3:]), str(a[1]), str(b[1])) for a in points for b in points if a[0] == b[0] == d and b[2] == a[2] + 2 and gap(a[3:], b[3:]) <= gate]
        used, made, n = set(), [], 0
        for _, s, t in sorted(props):
            if n >= most or {s, t} & used:
                continue
            n, used = n + 1, used | {s, t}
            a, b = at[int(s)], at[int(t)]
            mid = tuple((x + y) / 2 for x, y in zip(a[3:], b[3:]))
            old = [(gap(p[3:], mid), p[1], p) for p in points if p[0] == d and p[2] == a[2] + 1 and gap(p[3:], mid) <= reuse]
            options = [(o[0], str(o[1]), o[2][3:], ("old", o[1])) for o in sorted(old, key=lambda o: o[:2])[:1]] + [(gap(m, mid), "m", m, ("new", d, a[2] + 1, m)) for t_, m in made if t_ == a[2] + 1 and gap(m, mid) <= reuse]
            bridge = min(options)[3] if options else ("new", d, a[2] + 1, mid)
            if not options:
                made.append((a[2] + 1, mid))
                places.add(bridge)
            links |= {(("old", int(s)), bridge), (bridge, ("old", int(t)))}
    known = {(p[0], p[1]) for p in points}
    new = {(r.dataset, r.node_id): ("new", r.dataset, r.t, (r.z, r.y, r.x)) for r in got_n.collect() if (r.dataset, r.node_id) not in known}
    name = lambda d, i: new.get((d, i), ("old", i))
    assert set(new.values()) == places and {(name(r.dataset, r.source), name(r.dataset, r.target)) for r in got_e.collect()} == links


def test_votes_taken_in_rounds_keep_degrees(spark):
    rnd = random.Random(4)
    graphs = []
    for g in range(3):
        n = [("d", i, i // 20, float(i % 20) * 10 + rnd.random(), rnd.random(), rnd.random()) for i in range(80)]
        e = {("d", i, (i // 20 + 1) * 20 + rnd.choice((i % 20, (i + 1) % 20))) for i in range(60)} | {("d", i, (i // 20 + 1) * 20 + (i + 1) % 20) for i in range(0, 60, 7)}
        graphs.append((spark.createDataFrame(n, "dataset string, node_id long, t int, z double, y double, x double"), spark.createDataFrame(sorted(e), "dataset string, source long, target long")))
    points, taken = C.consensus(graphs)
    rows = taken.collect()
    sources, targets = [r.source for r in rows], [r.target for r in rows]
    assert len(set(targets)) == len(targets) and max(map(sources.count, sources)) <= 2 and len(rows) > 50 and points.count() == 80


def test_rescue_orders_no_more_than_the_room(spark):
    rnd = random.Random(5)
    n, e, want = [], [], []
    for c in range(60):
        size = rnd.choice((4, 5))
        n += [("d", 100 * c + k, k, float(c) * 50, 0.0, 0.5 * k) for k in range(size)]
        e += [("d", 100 * c + k, 100 * c + k + 1, 0.9 + (c % 7) / 100, 1.0) for k in range(size - 1)]
        want.append((0.9 + (c % 7) / 100, 100 * c, size))
    nodes = spark.createDataFrame(n, "dataset string, node_id long, t int, z double, y double, x double")
    edges = spark.createDataFrame(e, "dataset string, source long, target long, probability double, distance double")
    room, saved = min(37, int(len(n) * 0.5)), set()
    for _, c, size in sorted(want, key=lambda w: (-round(w[0], 9), w[1])):
        if size <= room:
            room -= size
            saved |= set(range(c, c + size))
    assert {r.node_id for r in R.short_tracks(nodes, edges, 6, 4, 0.5, 3.0, 0.5, 37).collect()} == saved


def test_clusters_by_cells_equal_the_scan_of_all(spark):
    rnd = random.Random(12)
    rows = [("d", t, g, 1000 * g + i, *(rnd.randrange(0, 14) / 2 for _ in range(3))) for t in range(2) for g in range(4) for i in range(50)]
    nodes = spark.createDataFrame([(d, i + 500 * t, t, z, y, x, g) for d, t, g, i, z, y, x in rows], "dataset string, node_id long, t int, z double, y double, x double, graph int")
    want = {}
    for t in range(2):
        clusters = []
        for r in sorted((r for r in nodes.collect() if r.t == t), key=lambda r: (r.graph, r.node_id)):
            best, at = 1.5, None
            for c in clusters:
                mean = [sum(p[k] for p in c["points"]) / len(c["points"]) for k in range(3)]
                d = sum((a - b) ** 2 for a, b in zip((r.z, r.y, r.x), mean)) ** 0.5
                if r.graph not in c["graphs"] and d <= best:
                    best, at = d, c
            if at is None:
                at = {"points": [], "graphs": set(), "name": r.graph * 10**12 + r.node_id}
                clusters.append(at)
            at["points"].append((r.z, r.y, r.x))
            at["graphs"].add(r.graph)
            want[t, r.graph, r.node_id] = at["name"]
    assert {(r.t, r.graph, r.node_id): r.cluster for r in C.cluster(nodes, 1.5).collect()} == want


@pytest.mark.parametrize("graphs, radius", [(2, 2.0), (4, 1.5)])
def test_clusters_by_parts_equal_the_sequence_of_a_frame(spark, graphs, radius):
    rng = np.random.default_rng(graphs)
    rows = [(d, t, int(i), *map(float, np.round(rng.uniform(0, (4, 12, 12)) * 2) / 2), g) for d in "ab" for t in (0, 1) for g in range(graphs) for i in rng.choice(500, 40, False) + 1000 * t]
    nodes = spark.createDataFrame(rows, "dataset string, t int, node_id bigint, z double, y double, x double, graph int")
    got = {(r.dataset, r.t, r.graph, r.node_id): r.cluster for r in C.cluster(nodes, radius).collect()}
    want = {}
    for d, t in {r[:2] for r in rows}:
        found = []  # first point's name, points, graphs
        for _, _, i, z, y, x, g in sorted((r for r in rows if r[:2] == (d, t)), key=lambda r: (r[6], r[2])):
            near = [(sum((sum(p[a] for p in c[1]) / len(c[1]) - v) ** 2 for a, v in enumerate((z, y, x))) ** 0.5, -k) for k, c in enumerate(found) if g not in c[2]]
            near = [n for n in near if n[0] <= radius]
            if near:
                at = found[-min(near)[1]]
            else:
                at = (g * 10**12 + i, [], set())
                found.append(at)
            at[1].append((z, y, x))
            at[2].add(g)
            want[d, t, g, i] = at[0]
    assert got == want and len(set(want.values())) < len(want)
    parts = C.apart(nodes, radius).groupBy("dataset", "t").agg(F.countDistinct("_part").alias("n")).collect()
    assert all(r.n > 1 for r in parts) or graphs > 2


def test_capped_greedy_takes_up_the_first_pairs_only(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("d", t, t * 100 + a, t * 100 + 50 + b, rng.choice([0.5, 1.0, rng.random() * 30]), 9, 4) for t in range(4) for a in range(8) for b in range(8) if rng.random() < 0.7]
    got, used, frames = [], set(), {}
    for r in sorted(rows, key=lambda r: (r[4], r[2], r[3])):
        if len(got) < 9 and frames.get(r[1], 0) < 4 and not {r[2], r[3]} & used:
            got.append(r[2:4])
            used |= {r[2], r[3]}
            frames[r[1]] = frames.get(r[1], 0) + 1
    df = spark.createDataFrame(rows, "dataset string, t int, source bigint, target bigint, cost double, room int, frame_room int")
    for few in (1, 20, 100_000):
        monkeypatch.setattr(S, "FEW_LOWEST", few)
        taken = S.greedy(df, ["cost", "source", "target"], "source", "target", limit="room", frame="t", frame_limit="frame_room")
        assert sorted((r.source, r.target) for r in taken.collect()) == sorted(got)

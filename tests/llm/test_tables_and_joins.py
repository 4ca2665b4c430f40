"""op2, op4, op5, op8 and the pipeline on odd inputs and against plain versions."""

import collections
import hashlib
import re
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from cladeframe.llm import ann_projection as ann
from cladeframe.llm import jaccard_join as jj
from cladeframe.llm import tables
from cladeframe.llm import url_rules as url
from cladeframe.llm import warc_fixity as warc
from cladeframe.llm.components import connected_components
from tests.llm.conftest import DOCS, make_docs, rows_of

URLS = [
    (1, "http://a.com"), (2, "http://a.com/x"), (3, "https://Example.COM/en/1?q=1"), (4, "http://www.example.com/en/"), (5, "http://x.www.example.com/en/a"), (6, "http://b.net/es/x"),
    (7, "http://net/fr/"), (8, "ftp no scheme"), (9, None), (10, "http://notexample.com/en/1"), (11, "http://c.org/a#b/c"), (12, "x://y://z.net/fr/1"), (None, "http://b.net/es/x"), (6, "http://b.net/es/x"),
]


def test_url_parts_and_fixed_rules(spark, no_labels):
    pages = spark.createDataFrame([(*u, "x", "y") for u in URLS], "page_id long, url string, host string, verdict string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url.url_filter(pages, no_labels).collect()}
    assert got[1, "a.com", ""] == (None, "allow") and got[2, "a.com", "/x"] == ("com/", "allow")
    assert got[3, "example.com", "/en/1"] == ("example.com/en/", "block") and got[4, "www.example.com", "/en/"] == ("www.example.com/en/", "allow")
    assert got[5, "x.www.example.com", "/en/a"] == ("www.example.com/en/", "allow") and got[6, "b.net", "/es/x"] == ("net/es/", "block")
    assert got[7, "net", "/fr/"] == ("net/fr/", "block") and got[8, "", ""] == (None, "allow") and got[9, "", ""] == (None, "allow")
    assert got[10, "notexample.com", "/en/1"] == ("com/", "allow") and got[11, "c.org", "/a"] == (None, "allow")
    assert got[12, "y:", "//z.net/fr/1"] == (None, "allow")
    assert url.url_filter(pages, no_labels).count() == len(URLS)
    assert url.url_filter(pages.limit(0), no_labels).count() == 0


def plain_rules(rows, bad, min_support, min_confidence, max_tokens, min_count, sigmas):
    """Rules over urls without query, by counting every combination of tokens."""
    import itertools
    import math

    sets = []
    for i, u in rows:
        host, path = re.match(r"http://([^/]*)(.*)", u).groups()
        plain = [re.sub("[0-9]+", "#", x) for x in path.split("/") if x]
        sets.append((frozenset(["h:" + x for x in host.split(".")] + ["p:" + x for x in plain]), bad[i]))
    n_bad, n = sum(b for _, b in sets), len(sets)
    share, rules = n_bad / n, {}
    for k in range(1, max_tokens + 1):
        for items in itertools.combinations(sorted(set().union(*(s for s, _ in sets))), k):
            seen = [b for s, b in sets if s.issuperset(items)]
            fits = sum(seen) >= max(min_count, math.ceil(min_support * n_bad)) and sum(seen) >= min_confidence * len(seen)
            if fits and sum(seen) - len(seen) * share >= sigmas * (len(seen) * share * (1 - share)) ** 0.5 and not any(set(r) < set(items) for r in rules):
                rules[items] = (sum(seen), round(sum(seen) / len(seen), 6))
    return rules


def test_mined_rules_match_plain_mining(spark):
    import random

    rnd = random.Random(3)
    # u and v always come together
    rows = [(i, f"http://{rnd.choice('abc')}.{rnd.choice('xyz')}.org/{rnd.choice(['p', 'q', 'u/v'])}/{i}") for i in range(240)]
    labels = [(i, int(".x.org/q" not in u and rnd.random() > 0.2), 0) for i, u in rows]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, tokens string")
    said = spark.createDataFrame(labels + labels[:40], "doc_id long, quality int, toxic int")  # repeated labels
    bad = {i: q == 0 for i, q, _ in labels}
    for args in ((0.1, 0.6, 2, 1, 0.0), (0.02, 0.5, 3, 10, 3.0), (0.02, 0.3, 3, 4, 0.0)):
        got = {tuple(r["items"]): (r["support"], round(r["confidence"], 6)) for r in url.mine_rules(pages, said, *args).collect()}
        assert got == plain_rules(rows, bad, *args) and got, args


def test_a_url_of_many_parts_makes_no_power_set(spark):
    long = "/".join(f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40))
    rows = [(i, f"http://a.org/{long}/{i}" if i % 4 == 0 else f"http://{'ab'[i % 2]}.org/x/{i}") for i in range(200)] + [(1003, "http://a.org/" + "y/" * 20_000), (1001, None), (1002, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    said = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    rules = url.mine_rules(pages, said).collect()
    assert sorted(r["items"][0] for r in rules if r.confidence == 1.0) == sorted("p:" + x for x in long.split("/")) and len(rules) <= 42
    got = url.url_filter(pages.union(spark.createDataFrame([(None, None)] * 50, "page_id long, url string")), said).collect()
    assert len(got) == len(rows) + 50 and all(r.mined for r in got if r.page_id is not None and r.page_id < 200 and r.page_id % 4 == 0)
    assert not any(r.mined for r in got if r.page_id in (None, 1001, 1002))


def plain_nearest(rows, every, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q in sorted({i for i, _ in ok if i % every == 0}):
        vec = min((tuple(v) for i, v in ok if i == q))
        near = sorted((float(((v - vec) ** 2).sum()), i) for i, v in ok if i != q)[:k]
        out[q] = [(i, r + 1, d**0.5) for r, (d, i) in enumerate(near)]
    return out


def test_neighbours_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 0.0, 0.0]) for i in range(60)] + [(2000, [1.0, 0.0, 0.0])]  # ties
    rows += [(3000, None), (3001, [0.0, 0.0, 0.0]), (3002, [float("nan"), 1.0, 1.0]), (3003, [float("inf"), 1.0, 1.0]), (3004, [None, 1.0, 1.0]), (3005, [1.0]), (None, [1.0, 1.0, 1.0]), (3006, []), (7, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, cell string, point double")
    monkeypatch.setattr(ann, "CELL_ROWS", 60)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "LEAF_ROWS", 8)
    got = collections.defaultdict(list)
    for r in ann.nearest(df, 20, 10, dims=3, confidence=0.999).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r["rank"], r.score))
    want = plain_nearest(rows, 20, 10)
    assert got.keys() == want.keys()
    hit = 0
    for q, near in want.items():
        assert [x[1] for x in got[q]] == list(range(1, 11)) and [x[2] for x in got[q]] == sorted(x[2] for x in got[q])
        hit += len({x[0] for x in near} & {x[0] for x in got[q]})
    assert hit >= 0.97 * 10 * len(want)
    assert [x[0] for x in got[2000]] == list(range(1000, 1010)) and got[2000][0][2] == 0
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(df.filter("vec_id in (0, 5, 6)"), 100).collect()
    assert sorted(r.vec_id for r in few) == [5, 6]


def plain_components(rows):
    sets = {}
    for n, (i, text) in enumerate(rows):
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[n] = frozenset(tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))) if w else frozenset()
    lead = {n: n for n in sets}

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a in sets:
        for b in range(a):
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                lead[top(a)] = top(b)
    low = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            low[top(n)] = min(low.get(top(n), i), i)
    return collections.Counter((i, len(sets[n]), i if not sets[n] else low.get(top(n))) for n, (i, _) in enumerate(rows))


def test_copies_in_other_blocks_and_cells_are_found():
    project = ann.directions(64)
    for seed in range(20):
        vector = np.random.default_rng(seed).standard_normal(64)
        one = ann.Block(np.arange(5, 25), np.tile(vector, (20, 1)), project)
        for rows in (1, 2, 7, 1000):
            point = (np.tile(vector, (rows, 1)) @ project)[0]
            assert one.search(0, vector, point, 0.0, 20.0)[0] == [(0.0, i) for i in range(5, 15)]


def test_copies_over_several_blocks_tie_to_the_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 40)
    monkeypatch.setattr(ann, "CELL_ROWS", 80)
    vector = [float(x) for x in np.random.default_rng(3).standard_normal(64)]
    df = spark.createDataFrame([(i, vector) for i in range(300)], "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r)[:4] for r in ann.nearest(df, 100, 10).orderBy("query_id", "rank").collect()]
    assert got == [(q, k + 1, i, 0.0) for q in (0, 100, 200) for k, i in enumerate([x for x in range(11) if x != q][:10])]


def test_repeated_rows_of_the_query_itself_do_not_hide_others():
    vector = np.arange(1.0, 65.0)
    project = ann.directions(64)
    one = ann.Block(np.array([3] * 40 + [4] * 15 + [9, 10]), np.tile(vector, (57, 1)), project)
    point = vector @ project
    assert one.search(3, vector, point, np.inf, 20.0)[0] == [(0.0, 4)] * 10
    assert one.search(4, vector, point, np.inf, 20.0)[0] == [(0.0, 3)] * 10
    two = ann.Block(np.array([3] * 40 + [4, 9, 10]), np.tile(vector, (43, 1)), project)
    assert two.search(3, vector, point, np.inf, 20.0)[0] == [(0.0, 4), (0.0, 9), (0.0, 10)]


def test_the_stopping_test_stops_and_finds_nine_in_ten(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 1500)
    monkeypatch.setattr(ann, "CELL_ROWS", 3000)
    rng = np.random.default_rng(12)
    some = rng.standard_normal((6000, 64))
    near = rng.standard_normal((60, 64))[rng.integers(0, 60, 3000)] + 0.15 * rng.standard_normal((3000, 64))  # in groups
    v = np.concatenate([some, near])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    df = df.union(df.filter("vec_id = 100"))  # a repeated query id
    got = collections.defaultdict(list)
    verified = {}
    for r in ann.nearest(df, 50).collect():
        got[r.query_id].append(r.vec_id)
        verified[r.query_id] = r.verified
    hit = share = 0
    for q, found in got.items():
        d = ((v - v[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(found) & set(np.argsort(d)[:10].tolist()))
        share += verified[q] / len(v)
    assert len(got) == 180 and hit >= 0.92 * 10 * len(got)
    assert share / len(got) < 0.4


def near_copies(n, seed):
    import random

    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(1000)}" for _ in range(100)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rnd.randrange(6)):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(50)}"
        out.append((1000 * seed + k, " ".join(w)))
    return out


def test_components_match_all_pairs(spark, docs, monkeypatch):
    rows = [(i, t) for i, t, *_ in make_docs()] + near_copies(30, 2) + near_copies(12, 3)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, cls string, n long")
    want = plain_components(rows)
    for short, sets, hub, sent in ((32, 2000, 500, 16 << 20), (1, 3, 2, 0)):
        monkeypatch.setattr(jj, "SHORT_LIST", short)
        monkeypatch.setattr(jj, "BLOCK_SETS", sets)
        monkeypatch.setattr(jj, "HUB_ROWS", hub)
        monkeypatch.setattr(tables, "BROADCAST_BYTES", sent)
        got = collections.Counter(map(tuple, jj.jaccard_components(df, sketch_bits=16).collect()))
        assert got == want, (short, got - want, want - got)
    assert jj.jaccard_components(spark.createDataFrame([], DOCS)).count() == 0


def test_packed_tokens_come_back():
    rng = np.random.default_rng(4)
    for tokens in (np.zeros(0, np.uint64), np.array([0, 0, 5, (1 << 48) - 1], np.uint64), np.sort(rng.integers(0, 1 << 48, 1000).astype(np.uint64))):
        assert (jj.unpack(jj.pack(tokens)) == tokens).all()


def test_a_hub_of_many_near_copies_is_one_component(spark):
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join([f"only{i}", *base])) for i in range(10_000)]
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), sketch_bits=16)
    assert collections.Counter((r.n_shingles, r.component_id) for r in got.collect()) == {(58, 0): 10_000}


def test_long_lists_of_texts_that_do_not_link(spark, monkeypatch):
    import random

    rnd = random.Random(8)
    passages = [" ".join(f"p{k}w{j}" for j in range(10)) for k in range(16)]
    rows = [(i, " ".join(rnd.sample(passages, 8))) for i in range(200)]
    rows += [(500 + i, rows[i][1] + " more") for i in range(10)]
    monkeypatch.setattr(jj, "BLOCK_SETS", 40)
    got = jj.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), sketch_bits=16)
    assert collections.Counter(map(tuple, got.collect())) == plain_components(rows)


def test_block_links_are_the_qualifying_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.97], rng.integers(0, 1 << 60, 3).astype(np.uint64)])) for _ in range(25)]
    links = jj.block_links(np.arange(25), np.arange(25), sets)
    lead = list(range(25))

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in links:
        c = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c)
        lead[top(a)] = top(b)
    for a in range(25):
        for b in range(a):
            c = len(np.intersect1d(sets[a], sets[b]))
            if 100 * c >= 85 * (len(sets[a]) + len(sets[b]) - c):
                assert top(a) == top(b)


def test_long_chain_is_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(connected_components(df, "a", "b", "t").collect())
    assert {got[i] for i in range(61)} == {0} and got[101] == 100


def plain_records(rows):
    """rid -> (page_id, head, bytes) by hand."""
    out = {}
    for i, u, h, *_ in rows:
        body = (h or "").encode()
        payload = hashlib.sha256(f"{u or ''}\n{h or ''}".encode()).hexdigest()
        rid = f"{'null' if i is None else i}-{payload}"
        head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{rid}>\r\nWARC-Target-URI: {u or ''}\r\nContent-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        out[rid] = (i, head, head + body + b"\r\n\r\n")
    return out


def test_fixity_finds_exactly_the_damage(spark, monkeypatch):
    rows = [(i, f"http://h/{i}", f"<p>é{i}</p>" * (i % 40), "x") for i in range(600)] + [(5, "http://h/5", "<p>é5</p>" * 5, "x"), (None, None, None, "x"), (None, "u", "", "x")]
    rows += [(7, f"http://again/{k}", "<p>other</p>", "x") for k in range(40)]  # one id, other bytes
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    monkeypatch.setattr(warc, "FILE_PAGES", 16)
    records = plain_records(rows)
    index = warc.lay_out(pages).cache()
    assert {r.record_id: (r.page_id, r.length, r.digest) for r in index.collect()} == {k: (i, len(b), hashlib.sha256(b).hexdigest()) for k, (i, _, b) in records.items()}
    assert index.count() == 642  # the repeated page is one record
    assert index.groupBy("tree", "number").count().agg(F.max("count")).first()[0] <= 3 * 16
    assert warc.audit(index, index).count() == 0
    for _, group in index.toPandas().sort_values("offset").groupby(["tree", "number"]):
        assert (group.offset.to_numpy()[1:] == group.length.cumsum().to_numpy()[:-1]).all() and group.leaf.is_monotonic_increasing
    got = {r.record_id: (r.status, r.digest_b) for r in warc.audit_damaged(pages).collect()}
    want = {}
    for rid, (_, head, b) in records.items():
        fault = hashlib.sha256(b).hexdigest()[:2]
        if fault <= "0f":
            want[rid] = ("corrupt", hashlib.sha256(head + (b"Y" if b[len(head) : len(head) + 1] == b"X" else b"X") + b[len(head) + 1 :]).hexdigest())
        elif fault <= "17":
            want[rid] = ("missing", None)
        elif fault <= "1f":
            want[rid] = ("corrupt", hashlib.sha256(b[: len(b) - len(b) // 3]).hexdigest())
    assert got == want and {v[0] for v in want.values()} == {"corrupt", "missing"}
    lost = [(r.status, r.page_id) for r in warc.audit(warc.lay_out(pages.filter("page_id <> 9 OR page_id IS NULL")), index).collect()]
    assert lost == [("extra", 9)]
    assert warc.audit_damaged(pages.limit(0)).count() == 0


def test_a_record_of_another_length_marks_its_own_range_only(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", "<p>text</p>" * 9) for i in range(256)], "page_id long, url string, html string")
    known = warc.records(pages).withColumn("length_b", F.expr("CASE WHEN page_id = 20 THEN length_a + 7 ELSE length_a END"))
    known = known.withColumn("digest_b", F.expr("CASE WHEN page_id = 20 THEN 'other' WHEN page_id <> 90 THEN digest_a END"))
    a, b = (warc.offsets(known, side) for side in "ab")
    assert sorted(r.leaf for r in warc.differing(warc.trees(a), warc.trees(b)).collect()) == [1, 5]
    assert sorted((r.page_id, r.status) for r in warc.audit(a, b).collect()) == [(20, "corrupt"), (90, "missing")]
    assert b.filter("page_id = 255").first().offset != a.filter("page_id = 255").first().offset


def test_pipeline_stages_keep_columns_and_take_effect(spark, odd_docs, tmp_path, labels):
    labels.write.parquet(f"file://{tmp_path}/labels.parquet")
    docs = odd_docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"file://{tmp_path}")
        out.write.parquet(f"file://{tmp_path}/stage{k}")
        out = spark.read.parquet(f"file://{tmp_path}/stage{k}")
        if k < 4:
            assert out.columns == odd_docs.columns, name
        if name == "language":
            assert out.filter("doc_id between 200 and 203").count() == 0 and out.filter("doc_id < 40").count() == 40
        if name == "near_copies":
            ids = [r.doc_id for r in out.select("doc_id").collect()]
            assert 110 not in ids and 111 not in ids and ids.count(204) + ids.count(205) <= 1 and ids.count(100) == 1 and set(range(40)) <= set(ids)
        if name == "personal_data":
            assert out.count() == docs.count()
        docs = out
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"} and docs.count() > 40
    empty = odd_docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, f"file://{tmp_path}").count() == 0


def test_near_copies_decides_by_row_not_by_id(spark, tmp_path):
    (_, a), (_, a2), (_, b), (_, c), (_, c2) = near_copies(1, 4) + near_copies(1, 4) + near_copies(1, 5) + near_copies(1, 6) + near_copies(1, 6)
    a2, c2 = a2 + " more", c2 + " more"
    # 2 is shared by a copy of 1 and a text of its own; c is in rows without an id only; 7 has one text in two cases
    rows = [(1, a), (2, a2), (2, b), (None, c), (None, c2), (None, c), (None, a2), (8, None), (8, None), (None, ""), (None, ""), (7, "x y z one"), (7, "X y z one"), (None, "a b d e f g")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, cls int")
    got = corpus_pipeline.near_copies(spark, df, f"file://{tmp_path}")
    assert got.columns == df.columns
    found = collections.Counter(map(tuple, got.select("doc_id", "text").collect()))
    of_c = {t: found.pop((None, t), 0) for t in (c, c2)}
    assert sum(of_c.values()) == 1
    assert found == collections.Counter({(1, a): 1, (2, b): 1, (8, None): 1, (None, ""): 2, (7, "X y z one"): 1, (None, "a b d e f g"): 1})


def test_rows_are_the_same_whatever_the_order(spark, docs):
    shuffled = docs.repartition(7)
    assert rows_of(jj.jaccard_components(shuffled, sketch_bits=16), "doc_id", "component_id") == rows_of(jj.jaccard_components(docs, sketch_bits=16), "doc_id", "component_id")


def test_overlapping_parts_make_no_power_set(spark):
    """300 bad urls each hold all but two of 40 parts: supports overlap, none is equal."""
    parts = [f"part{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(40)]
    rows = [(i, "http://a.org/" + "/".join(p for k, p in enumerate(parts) if k not in (i % 40, (i * 7 + 3) % 40))) for i in range(300)]
    rows += [(1000 + i, f"http://a.org/x/{i}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    said = spark.createDataFrame([(i, int(i >= 1000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    began = time.time()
    got = {r.page_id: r.mined for r in url.url_filter(pages, said).collect()}
    assert time.time() - began < 60 and got == {i: i < 1000 for i, _ in rows}


def test_items_of_many_tokens_are_not_written_out(spark):
    """Three items of 300 tokens each make one rule: only their tokens are looked up, not their 27,000,000 choices."""
    words = {k: "/".join(f"{k}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)) for k in "uvw"}
    # every pair of items is as common among good pages as among bad ones; the three together are bad
    rows = [(i, f"http://a.org/{words['u']}/{words['v']}/{words['w']}") for i in range(60)]
    for j, pair in enumerate(("uv", "uw", "vw")):
        rows += [(1000 * (j + 1) + i, "http://a.org/" + "/".join(words[k] for k in pair)) for i in range(90)]
    pages = spark.createDataFrame(rows + [(None, "http://b.org/uaa/vab/wac"), (9000, "http://b.org/uaa/vab")], "page_id long, url string")
    said = spark.createDataFrame([(i, int(i >= 1000), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    rules, items = url.mine_items(pages, said, 0.02, 0.5, 3, 10, 3.0)
    assert [sorted(r["items"]) for r in rules.collect()] == [["p:uaa", "p:vaa", "p:waa"]] and sorted(len(r.tokens) for r in items.collect())[-3:] == [300] * 3
    got = {r.page_id: r.mined for r in url.url_filter(pages, said).collect()}
    assert got == {i: i < 1000 for i, _ in rows} | {None: True, 9000: False}


def test_files_of_negative_and_other_ids_end_in_two_roots(spark):
    pages = spark.createDataFrame([(-5, "u", "a"), (5, "v", "b"), (-70_000, "w", "c"), (90_000, "x", "d"), (None, "y", "e")], "page_id long, url string, html string")
    a = warc.lay_out(pages)
    levels = warc.trees(a)
    assert sorted((r.tree, r.number) for r in levels[-1].collect()) == [("crawl", -1), ("crawl", 0), ("null", 0)]
    changed = warc.lay_out(pages.withColumn("html", F.when(F.col("page_id") == -5, F.lit("z")).otherwise(F.col("html"))))
    assert sorted((r.page_id, r.status) for r in warc.audit(a, changed).collect()) == [(-5, "extra"), (-5, "missing")]

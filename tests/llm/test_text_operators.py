"""op1, op3, op6, op7, op9, op10 on odd inputs and against plain versions."""

import collections
import hashlib
import math
import re
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cladeframe.llm import bpe_transducer as bpe
from cladeframe.llm import langid_bloom as lang
from cladeframe.llm import pii_crf as pii
from cladeframe.llm import quality_llr as llr
from cladeframe.llm import source_mixing as mixing
from cladeframe.llm import wordpiece_counts as wp
from tests.llm.conftest import SF, make_docs, rows_of

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_base(text):
    w = WORD.findall(text or "")
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed


def bucket(*words):
    h = 42
    for w in words:
        h = xxhash.xxh64(w.encode(), seed=h).intdigest()
    return (h - (1 << 64) if h >> 63 else h) % llr.N_BUCKETS


def test_quality_matches_plain_version(spark, docs, labels):
    got = {(r.doc_id, r.n_words, r.n_symbols): r for r in llr.quality_filter(docs, labels).collect()}
    said = collections.defaultdict(list)
    for r in labels.collect():
        said[r.doc_id].append(r.quality == 1 and not r.toxic)
    counts = [collections.Counter(), collections.Counter()]
    grams = {}
    for i, text, *_ in make_docs():
        w = WORD.findall(text or "")
        g = [bucket(x) for x in w] + [bucket(a, b) for a, b in zip(w, w[1:])]
        grams[i, text] = g
        counts[1].update(g)
        if i is not None and said[i] and all(said[i]):
            counts[0].update(g)
    nt, nr = (sum(c.values()) + llr.N_BUCKETS for c in counts)
    for i, text, *_ in make_docs():
        base = plain_base(text)
        r = got[i, base[0], base[2]]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base
        g = grams[i, text]
        want = sum(math.log((counts[0][b] + 1) / nt) - math.log((counts[1][b] + 1) / nr) for b in g) / max(len(g), 1)
        assert r.llr == pytest.approx(want, abs=1e-4)
        assert r.kept == (not base[5] and want >= llr.THRESHOLD)


def test_quality_counts_on_lines_and_symbols(spark, no_labels):
    texts = ["a b\n\na b\n \nc\na b", "x" * 5 + " |#| é\x0bü", "a b c a b c a b c d"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in llr.quality_filter(df, no_labels).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_base(texts[r.doc_id])
        assert r.llr == 0


def test_language_learns_only_from_its_folds(spark, docs):
    got = lang.identify(docs).collect()
    assert len(got) == docs.count()
    by = {(r.doc_id): r for r in got}
    assert {by[i].lang_pred for i in (200, 201, 202, 203)} == {"und"} and by[200].score == 0
    import zlib

    for i, _, want, *_ in make_docs()[:40]:
        assert by[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert by[i].lang_pred == want and 0 < by[i].score <= 1
    changed = docs.withColumn("lang", F.when(lang.fold(F.col("doc_id")) == 2, "zz").otherwise(F.col("lang")))
    assert rows_of(lang.identify(changed), "doc_id", "lang_pred", "score") == rows_of(lang.identify(docs), "doc_id", "lang_pred", "score")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = lang.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)


def test_rare_languages_are_learned_from_a_bounded_sample(spark):
    rows = [(i, f"the river house walks over {i}", "en") for i in range(3000)] + [(9000 + i, f"zażółć gęślą jaźń {i}", "pl") for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    usable = df.filter(lang.fold(F.col("doc_id")) != 2)
    chosen = {r.lang: r["count"] for r in lang.sample_by_language(usable, 60).groupBy("lang").count().collect()}
    assert chosen["pl"] == usable.filter("lang = 'pl'").count() > 0 and 20 <= chosen["en"] <= 90
    got = lang.identify(df, max_train_docs=60).filter("doc_id >= 9000").collect()
    assert len(got) == 8 and {r.lang_pred for r in got} == {"pl"}


def plain_languages(rows, min_rate):
    """(prediction, score without the filter's correction) by exact sets of trigrams."""
    import zlib

    def grams(text):
        padded = " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        return [padded[k - 1 : k + 2] for k in range(1, len(padded) - 1) if padded[k] != " "]

    counts = collections.defaultdict(collections.Counter)
    for i, text, lang, *_ in rows:
        if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and lang is not None and text is not None:
            counts[lang].update(grams(text))
    known = {lang: {g for g, n in c.items() if n >= min_rate * sum(c.values())} for lang, c in counts.items()}
    out = []
    for i, text, *_ in rows:
        said = grams(text)
        hits = {lang: sum(g in known[lang] for g in said) for lang in sorted(known)}
        best = max(hits, key=lambda x: hits[x])
        out.append((i, best if said else "und", hits[best] / len(said) if said else 0.0, hits))
    return out


def test_language_equals_exact_sets_within_the_filters_error(spark):
    rows = make_docs() + [(400, "x" * 700_000 + " der schöne fluß", "en", "s", 1), (401, "", "de", "s", 0), (402, "le la les", "fr", "s", 1), (403, "le la les", "es", "s", 1)]
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id long, text string, lang string, source string")
    got = collections.Counter((r.doc_id, r.lang_pred) for r in lang.identify(df).collect())
    scores = {(r.doc_id, r.lang_pred): r.score for r in lang.identify(df).collect()}
    for i, best, score, hits in plain_languages(rows, lang.MIN_RATE):
        ties = [x for x, n in hits.items() if n >= hits.get(best, 0) - 0.02 * max(sum(hits.values()), 1)] if best != "und" else ["und"]
        found = next(x for x in ties if got[i, x])
        assert abs(scores[i, found] - score) <= 0.03
        if len(ties) == 1:
            assert got[i, best]


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = "Über die Brücke, über den FLUSS geht es. " * 50
    whole = sorted(lang.trigrams([text])[0].tolist())
    monkeypatch.setattr(lang, "BLOCK_BYTES", 17)
    parts = [(c, d) for c, d in lang.gram_slices(["ab", text, None])]
    assert sorted(np.concatenate([c[d == 1] for c, d in parts]).tolist()) == whole


def test_language_masks_hold_every_language_of_a_gram():
    grams = {f"l{i:03}": np.arange(i, i + 50, dtype=np.uint64) for i in range(70)}
    f = lang.LanguageFilter(grams)
    masks = f.masks(np.arange(120, dtype=np.uint64))
    for i, name in enumerate(sorted(grams)):
        bits = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        assert bits[grams[name].astype(int)].all()


def test_word_pieces_match_greedy_longest_match(spark, docs):
    first, later = ["the", "th", "ho", "h", "ri", "r", "o", "s", "e", "ov"], ["use", "ver", "er", "e", "u", "s", "ver", "v", "he", "t"]

    def greedy(word):
        n, at, pieces = 0, 0, first
        while at < len(word):
            hit = max((p for p in pieces if word.startswith(p, at)), key=len, default=None)
            if hit is None:
                return None
            n, at, pieces = n + 1, at + len(hit), later
        return n

    got = collections.Counter(rows_of(wp.count_tokens(docs, first, later), "doc_id", "n_words", "n_tokens", "n_unknown"))
    want = collections.Counter()
    for i, text, *_ in make_docs():
        said = [greedy(w) for w in WORD.findall(text or "")]
        want[i, len(said), sum(1 if s is None else s for s in said), sum(s is None for s in said)] += 1
    assert got == want


def test_word_pieces_match_the_library(spark):
    from tokenizers import Tokenizer, models

    first, later = wp.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    vocab = {p: i for i, p in enumerate(dict.fromkeys([*first, *("##" + p for p in later), "[UNK]"]))}
    model = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=10**9, continuing_subword_prefix="##")).model
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    for r in wp.count_tokens(docs, first, later).limit(40).collect():
        assert r.n_tokens == sum(len(model.tokenize(w)) for w in WORD.findall(texts[r.doc_id]))


def test_mixing_meets_reachable_targets(spark, docs, labels, no_labels):
    got = mixing.mix(docs, labels, {"clean": 0.6, "low": 0.2, "toxic": 0.2}).toPandas()
    assert len(got) == docs.count() and (got.rate >= 0).all()
    p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    assert np.allclose(p.sum(1), 1)
    flat = mixing.mix(docs, no_labels).toPandas()
    assert np.allclose(flat[[f"p_{d}" for d in mixing.DOMAINS]], 1 / 3)


def test_projected_gradient_matches_a_dense_solution(spark):
    rng = np.random.default_rng(1)
    p = rng.dirichlet([1, 1, 1], 200)
    n = rng.integers(1, 100, 200)
    df = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p)], "n_tokens long, p_clean double, p_low double, p_toxic double")
    weights = {"clean": 0.5, "low": 0.3, "toxic": 0.2}
    taken = mixing.rate_steps(df, weights, steps=200, tolerance=1e-6)
    r = np.array([x[0] for x in df.select(mixing.rate(taken)).collect()])
    total = (r[:, None] * n[:, None] * p).sum(0)
    assert np.abs(total / n.sum() - [0.5, 0.3, 0.2]).max() < 1e-4 and (r >= 0).all()


@pytest.mark.parametrize("spread", [0.0, 0.04])
def test_production_steps_reach_the_least_squares_beside_very_long_documents(spark, spread):
    rng = np.random.default_rng(0)
    size = 20_000
    domain = rng.choice(3, size, p=[0.6, 0.3, 0.1])
    p = np.full((size, 3), 0.05)
    p[np.arange(size), domain] = 0.9
    p = np.abs(p + spread * rng.standard_normal((size, 3)))
    p /= p.sum(1, keepdims=True)
    n = rng.integers(50, 601, size)
    n[:3] = 1_000_000
    table = pa.table({"n_tokens": n, **{f"p_{d}": p[:, i] for i, d in enumerate(mixing.DOMAINS)}})
    for weights in (mixing.WEIGHTS, {"clean": 0.6, "low": 0.2, "toxic": 0.2}):
        df = spark.createDataFrame(table)
        r = np.array([x[0] for x in df.select(mixing.rate(mixing.rate_steps(df, weights))).collect()])
        want = np.array([weights[d] for d in mixing.DOMAINS])
        a = (n[:, None] * p).T / n.sum()
        gap = a @ r - want
        # no document's rate can go up, nor all rates up or down together, to lessen the squared gap
        assert (r >= 0).all() and (p @ gap).min() > -1e-3 and abs(gap @ (a @ r)) < 1e-3


def dense_rates(a, target, pull):
    """Rates >= 0 with the least half squared distance from 1 plus the squared gap of the totals over twice ``pull``, by trying every set of rates above 0."""
    k, n = a.shape
    for mask in range(1 << n):
        live = [i for i in range(n) if mask >> i & 1]
        r = np.zeros(n)
        if live:
            b = a[:, live]
            r[live] = np.linalg.solve(np.eye(len(live)) + b.T @ b / pull, 1 + b.T @ target / pull)
        slope = r - 1 + a.T @ (a @ r - target) / pull
        if (r[live] > -1e-9).all() and (slope[[i for i in range(n) if i not in live]] >= -1e-6).all():
            return r
    raise AssertionError


@pytest.mark.parametrize("case", ["reachable", "beyond", "a domain without rows", "one long text"])
def test_rates_equal_a_dense_solver(spark, monkeypatch, case):
    monkeypatch.setattr(mixing, "PULL", 1e-3)
    rng = np.random.default_rng(7)
    p, n = rng.dirichlet([1, 1, 1], 8), rng.integers(20, 200, 8)
    weights = {"clean": 0.5, "low": 0.3, "toxic": 0.2}
    if case == "beyond":
        p, weights = np.array([[0.7, 0.2, 0.1]] * 8), {"clean": 0.01, "low": 0.01, "toxic": 0.98}
    if case == "a domain without rows":
        p[:, 2] = 0
        p /= p.sum(1, keepdims=True)
    if case == "one long text":
        n[0] = 5000
    df = spark.createDataFrame([(int(k), *map(float, x)) for k, x in zip(n, p)], "n_tokens long, p_clean double, p_low double, p_toxic double").coalesce(1)
    got = np.array([x[0] for x in df.select(mixing.rate(mixing.rate_steps(df, weights, tolerance=1e-9))).collect()])
    total = n.sum()
    want = dense_rates((n[:, None] * p).T, np.array(list(weights.values())) * total, 1e-3 * total * total / 8)
    assert np.abs(got - want).max() < 1e-4


def test_mixing_sample_keeps_clean_documents(spark, odd_docs, labels):
    kept = mixing.sample(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    most = mixing.mix(odd_docs, labels).filter("domain = 'clean'")
    assert most.select("doc_id").subtract(kept.select("doc_id")).count() == 0


def plain_spans(text):
    kinds = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    out = []
    for k, pattern in enumerate(kinds):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = (True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 12 <= len(d) <= 19 and pii.luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((m.start(), k, m.end()))
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


def test_base_spans_match_plain_patterns():
    import random

    rnd = random.Random(2)
    for _ in range(3000):
        text = "".join(rnd.choice("aZ0159.@+- ()%_é\n") for _ in range(rnd.randint(0, 50)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("é a.b@c.de, 4539578763621486 and 1.2.3.4 or +1 (511) 555-6887")[0] == (2, 10, "email")
    assert not pii.base_spans("a" * 300_000) and not pii.base_spans("1" * 300_000)


def test_field_finds_secrets_and_leaves_numbers_alone():
    texts = ['then token = "0123456789abcdef0123456789abcdef01234567" goes on', "in 1998 we saw 1,204 of them, call 4111111111111112 no", "nothing here"]
    got = pii.all_spans(texts, pii.train())
    assert [k for *_, k in got[0][1]] == ["secret"] and got[1] == ([], []) and got[2] == ([], [])
    s, e, _ = got[0][1][0]
    assert texts[0][s:e] == '"0123456789abcdef0123456789abcdef01234567"'


@pytest.mark.parametrize("inside", ["4539578763621486", "10.20.30.40", "jane@mail.example.org"])
def test_secrets_with_a_base_span_inside_are_kept_and_masked_whole(spark, inside):
    text = f'then token = "a0b1c2d3e4f{inside}fa1b2c3d4e5f6" goes on'
    base, every = pii.all_spans([text], pii.train())[0]
    assert len(base) == 1 and base == pii.base_spans(text) and base[0] in every
    assert [text[s:e] for s, e, k in every if k == "secret"] == [f'"a0b1c2d3e4f{inside}fa1b2c3d4e5f6"']
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.redact(df).first().text == "then token = [SECRET] goes on"


def test_predicted_spans_that_add_nothing_are_dropped():
    text = "paid with 4539578763621486 in march, ask ana.lima@mail.example.org"
    base, every = pii.all_spans([text], pii.train())[0]
    assert len(base) == 2 and every == base
    assert not pii.adds("x 1.2.3.4 a@b.c", (2, 9, "secret"), [(2, 9, "ip")]) and not pii.adds('"1.2.3.4"', (0, 9, "ip"), [(1, 8, "ip")])
    assert pii.adds("k1.2.3.4 a@b.c", (0, 8, "secret"), [(1, 8, "ip")]) and pii.adds("1.2.3.4k", (0, 8, "secret"), [(0, 7, "ip")])


#: Held-out lines: what is to be found is in angle quotes; other words, values and forms than in the training table.
HELD_OUT = """\
the new access_key = «"Zk3vQpL09xTTbWcR7yNs"» goes into the vault tonight
set PASSWORD=«correctHorse7battery» before you start the server
my password is «gr33nTea!Cup» and nobody knows
client secret: «8f14e45fceea167a5a36dedd4bea2543»
Bearer «eyJhbGciOiJIUzI1NiIsInR5cCI6» was in the header
--token «ghx_9sKd82LmQpWz73hTyVbNcE41» on the command line
secret_key : «'d8e8fca2-dc51-4b1e-9a3c-1f2e3d4c5b6a'» end
kennwort = «Sommer2019xy» steht auf dem zettel
contraseña : «luzVerde88» dijo ella
mot de passe : «chat_noir_1987» pour la porte
api_key=«AKx7QQ2LMN55TTV9PRS3» in production
token = «"aabbccddeeff00112233445566778899aabbccdd"» . then more
credentials : «user9:qwErTy!45»
the clave = «"mZqLrTwXvB"» fue cambiada
write to anna at beispiel dot de if it rains
we met him at the dot com party in 1999
she has the key to the house and the password to his heart
token prices rose by 12% in 2021, they say
the secret of the bread is time and 3 eggs
invoice 20391122 of 4 may 2020, total 1,882.50
a = 5 and b = 7 give 12
build 9f2c1d0 of version 3.14.2 is out
open https://example.net/page?id=77&lang=en now
die alte zahl 1848 ist der schlüssel zur zeit
la clave del problema es la paciencia
le mot de passe est perdu depuis longtemps
room 12b = the large one, floor 2
McDonald and O'Brien = two families
key = value is how a line looks
phone 4 people and ask for 20 chairs
"""


def test_field_on_held_out_lines():
    found = wanted = right = 0
    for line in HELD_OUT.splitlines():
        text = line.replace("«", "").replace("»", "")
        where = [(m.start() - 2 * k, m.end() - 2 * k - 2) for k, m in enumerate(re.finditer("«[^»]*»", line))]
        got = [(s, e) for s, e, k in pii.all_spans([text], pii.train())[0][1] if k == "secret"]
        hit = [w for w in where if any(s < w[1] and e > w[0] and e - s <= 2 * (w[1] - w[0]) for s, e in got)]
        wanted, found, right = wanted + len(where), found + len(got), right + len(hit)
        print(len(hit), len(got), len(where), line, [text[s:e] for s, e in got])
    assert right >= 0.85 * wanted and right >= 0.85 * found, (right, wanted, found)


def test_field_finds_spelled_out_addresses_and_keys_without_digits():
    texts = ["mail tom at beispiel dot org for it", 'the password = "QwxZrTplKm" is old', "PASSWORT = \"abCdEfGhIj\" STEHT HIER"]
    got = pii.all_spans(texts, pii.train())
    assert [[k for *_, k in every] for _, every in got] == [["email"], ["secret"], ["secret"]]
    assert pii.plausible("email", "tom at beispiel dot org") and not pii.plausible("email", "we met at the dot") and not pii.plausible("secret", "plain Word")


def test_shapes_read_the_whole_token():
    assert pii.shape("a" * 100 + "-1") == "x-0" and pii.shape("x-" * 20) != pii.shape("x-" * 21) and pii.shape("a1b2c3d4") == "~"


def test_very_long_lines_and_repeated_rows_go_through_the_field(spark):
    long = "word " * 30_000 + 'token = "0123456789abcdef0123456789abcdef01234567" ' + "word " * 30_000
    df = spark.createDataFrame([(1, long), (1, long), (None, long)], "doc_id long, text string")
    got = [tuple(r) for r in pii.find(df).select("spans").collect()]
    at = long.index('"')
    assert got == [(f"secret:{at}:{at + 42}",)] * 3


def test_find_matches_plain_patterns_on_whole_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(map(tuple, docs.select("doc_id", "text").collect()))
    n = 0
    for r in pii.find(docs).collect():
        want = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.written(want).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for *_, k in want) for kind in pii.KINDS)
        assert {pii.written([x]) for x in want} <= set(r.spans.split(","))
        n += len(want)
    assert n > 5


def test_viterbi_is_the_best_path():
    import itertools

    f = pii.train()
    line = ["token", "=", '"ab12cd34ef56ab78"']
    feats = pii.line_features(line)
    score = np.array([sum((f.emit[f.number[x]] for x in fs if x in f.number), np.zeros(len(f.labels))) for fs in feats])

    def total(path):
        if not f.first[path[0]] or not all(f.allowed[a, b] for a, b in zip(path, path[1:])):
            return -np.inf
        return sum(score[i, k] for i, k in enumerate(path)) + sum(f.pair[a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product(range(len(f.labels)), repeat=3), key=total)
    assert tuple(f.decode([line, ["a"], line])[2]) == best


def test_personal_data_rows(spark, docs):
    got = pii.find(docs)
    assert got.count() == docs.count()
    none = hashlib.sha256(b"").hexdigest()
    r = got.filter("doc_id = 200").first()
    assert (r.n_email, r.base_sha256, r.spans) == (0, none, "")
    df = spark.createDataFrame([(1, "write a@b.co now", 16, "x"), (2, None, None, "y")], "doc_id long, text string, n_chars long, spans string")
    clean = {r.doc_id: r for r in pii.redact(df).collect()}
    assert clean[1].text == "write [EMAIL] now" and clean[1].n_chars == 17 and clean[1].spans == "x"
    assert clean[2].text is None and clean[2].n_chars is None


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Codec(bpe.read_ranks(f.read()), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.transducer.ranks, special_tokens={})


def test_encoding_matches_the_library(codec, library):
    import random

    rnd = random.Random(4)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "日本", "😀", "1", "'s", "'", "\x1c", "\xa0", "zz", "ing", "\t", "<|endoftext|>"]
    for _ in range(3000):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14)))
        ids = codec.encode(text)
        assert list(np.frombuffer(ids, "<u4")) == library.encode_ordinary(text), text
        assert codec.decode(ids) == text
    text = "ab" * 50_000
    assert list(np.frombuffer(codec.encode(text), "<u4")) == library.encode_ordinary(text)


def test_tables_of_bounded_size_change_nothing(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "STATE_LIMIT", 20)
    monkeypatch.setattr(bpe, "PIECE_LIMIT", 3)
    small = bpe.Codec(codec.transducer.ranks, public_tokenizers.PATTERN)
    text = "thinking rivers over überstraße and unbelievable things, again thinking rivers"
    assert list(np.frombuffer(small.encode(text), "<u4")) == library.encode_ordinary(text)


def test_streaming_decode_holds_back_unfinished_characters():
    data = "aé日😀z".encode()
    for cut in range(len(data) + 1):
        for cut2 in range(cut, len(data) + 1):
            m = bpe.Utf8Machine()
            assert m.feed(data[:cut]) + m.feed(data[cut:cut2]) + m.feed(data[cut2:]) + m.close() == "aé日😀z"
    m = bpe.Utf8Machine()
    assert m.feed(b"a\xff\xe2\x82") + m.close() == "a��"


def test_encoded_rows(spark, docs, library):
    got = bpe.encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    want = collections.Counter()
    for i, text, *_ in make_docs():
        ids = library.encode_ordinary(text or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, got)) == want


def test_extra_columns_and_empty_tables(spark, docs, odd_docs, empty_docs, labels, no_labels):
    first, later = ["a"], ["b"]
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    for f in (
        lambda d: llr.quality_filter(d, labels), lang.identify, lambda d: wp.count_tokens(d, first, later), lambda d: mixing.mix(d, labels),
        pii.find, lambda d: bpe.encode_texts(d, vocabulary, public_tokenizers.PATTERN),
    ):
        assert f(odd_docs).drop("rate").count() == docs.count()
        out = f(empty_docs)
        assert out.count() == 0 and out.columns == f(docs).columns
    assert llr.quality_filter(docs, no_labels).filter("llr <> 0").count() == 0


def test_rates_without_convergence_are_returned_and_logged(spark, caplog):
    rng = np.random.default_rng(6)
    n = rng.integers(1, 500, 400)
    p = rng.dirichlet([0.2, 0.2, 0.2], 400)
    df = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "n_tokens long, p_clean double, p_low double, p_toxic double")
    weights = {"clean": 0.98, "low": 0.015, "toxic": 0.005}
    a = (n[:, None] * p).T
    target = np.array([weights[d] for d in mixing.DOMAINS]) * n.sum()
    off = lambda steps: np.abs(a @ np.array([x[0] for x in df.select(mixing.rate(mixing.rate_steps(df, weights, steps=steps))).collect()]) - target).sum()
    with caplog.at_level("WARNING"):
        short = off(1)
    assert "clean" in caplog.text and short < np.abs(a.sum(1) - target).sum() and off(50) < 1e-3 * n.sum()


def test_prefilter_is_linear_and_finds_what_a_search_finds():
    began = time.time()
    for line in ("at " * 350_000, "word at. " * 110_000, "dot at " * 150_000, "key " * 250_000, "key" + " " * 1_000_000):
        sum(1 for _ in pii.pieces(line))
    assert time.time() - began < 5
    plain = re.compile(r"[0-9@+=]|token|secret|passw|pwd|api.?key|kennwort|contrase|clave|passe\b|credential|bearer|\b(?:at|arroba)\b.*\b(?:dot|punto|punkt)\b|(?<!\w)key\s*[:=]", re.IGNORECASE)
    rnd = np.random.default_rng(4)
    words = "at dot Arroba PUNTO punkt. key key: monkey: api-key passe passed Token bat dots the x@y 7 (at) [dot] clave".split()
    for _ in range(3000):
        line = " ".join(rnd.choice(words[rnd.integers(0, 8) :], rnd.integers(0, 5)))
        assert pii.triggered(line) == bool(plain.search(line)), line


def test_features_of_long_tokens_are_not_kept():
    before = pii._short_features.cache_info().currsize
    pii.token_features("q" * 65)
    assert pii._short_features.cache_info().currsize == before and pii.token_features("qq7") == pii.features_of("qq7")

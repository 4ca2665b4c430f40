"""Mixing to target weights with soft memberships.

1. A classifier of domains (``clean``, ``low`` quality, ``toxic``) is fitted on
   a bounded sample (``MAX_TRAIN_DOCS``) of the labelled documents: hashed word
   counts by domain give each word a log ratio for each domain, a document is
   described by the mean and the largest ratio of its words, and a softmax
   regression turns these into posteriors.  The counts that describe a
   training document leave out its own half of the sample.
2. Every document gets its posteriors ``p`` and its word count ``n``.  With
   rates ``r`` a domain's expected total is ``sum(r n p)``.
3. Projected least squares finds rates >= 0 whose expected totals match the
   targets, starting from rates of 1: one step along a combination of the
   system's rows, projected to rates >= 0.  Its one factor a domain solves the
   dual problem, by Newton's method; an iteration is one aggregation over the
   documents with a few numbers a domain as its result.  The rates are never
   stored: they are the step applied to a document's own columns, so a lost
   executor costs no state.

``WEIGHTS`` are the target shares of all tokens, of ``budget`` times the
present total.

Defined results
---------------
* null or empty text: no tokens, posteriors of the empty description, rate 1.
* no labels: one domain's posterior each alike; the rates still match as far
  as they can.  A domain without labelled rows gets posterior 0.
* targets that no rates >= 0 reach: the rates whose totals, in tokens, have the
  least squared distance from the targets (up to ``PULL``, which keeps them
  from running off).
* no convergence within ``2 STEPS`` passes: the rates reached, and a warning
  with what each domain is off.
* repeated rows, null ``doc_id``: one output row for each input row.
* extra columns are ignored.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm.tables import discard, map_text, materialize, maybe_broadcast, stable_sample
from cladeframe.llm.textnum import blocks, claim, lower_ascii, span_hashes, words

LOG = logging.getLogger(__name__)
DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.9, "low": 0.08, "toxic": 0.02}
MAX_TRAIN_DOCS = 20_000
BUCKETS = 1 << 16
STEPS = 50
TOLERANCE = 1e-4
#: Weight of the squared distance of the rates from 1 beside the squared distance of the totals from the targets.
PULL = 1e-8
#: Step lengths tried in one pass, each half the one before.
TRIES = 8


def domain_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain number): toxic if any label row says so, else low if one does, else clean."""
    toxic, low = F.coalesce(F.max("toxic"), F.lit(0)) == 1, F.coalesce(F.min("quality"), F.lit(0)) == 0
    return labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.when(toxic, 2).when(low, 1).otherwise(0).alias("domain")
    )


def _words(batch):
    claim("mixing")
    for first, last, data, offs in blocks(batch.column("text")):
        low = lower_ascii(data)
        starts, ends, doc = words(low, offs)
        yield first, last, (span_hashes(low, starts, ends) >> np.uint64(48)).astype(np.int64), doc


def _count(batches):
    """Word counts by half, domain and bucket of this task."""
    counts = np.zeros((2, len(DOMAINS), BUCKETS), np.int64)
    for batch in batches:
        domain, half = batch.column("domain").to_numpy(zero_copy_only=False), batch.column("half").to_numpy(zero_copy_only=False)
        for first, _, bucket, doc in _words(batch):
            key = (half[first + doc] * len(DOMAINS) + domain[first + doc]) * BUCKETS + bucket
            at, n = np.unique(key, return_counts=True)
            counts.reshape(-1)[at.astype(np.int64)] += n
    flat = counts.reshape(-1)
    at = np.flatnonzero(flat)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """For every domain and bucket: log of its share in the domain over its share elsewhere; rare buckets tend to 0."""
    out = np.zeros(counts.shape)
    total = counts.sum(0)
    for k in range(len(counts)):
        own, rest = counts[k], total - counts[k]
        if own.sum() and rest.sum():
            share = total / total.sum()
            # ten words of the overall mixture are added on either side
            a = (own + 10 * share) / (own.sum() + 10)
            b = (rest + 10 * share) / (rest.sum() + 10)
            with np.errstate(divide="ignore", invalid="ignore"):
                trust = total / (total + 5.0)
                out[k] = np.where(total > 0, trust * np.log(a / b), 0.0)
    return np.clip(np.nan_to_num(out), -8, 8)


def describe(bucket: np.ndarray, doc: np.ndarray, n_docs: int, ratios: np.ndarray) -> np.ndarray:
    """(documents, features): mean and largest ratio by domain, and a constant."""
    n = np.bincount(doc, minlength=n_docs)
    out = [np.ones(n_docs)]
    first = np.searchsorted(doc, np.arange(n_docs))
    some = n > 0
    for r in ratios:
        x = r[bucket]
        out.append(np.bincount(doc, weights=x, minlength=n_docs) / np.maximum(n, 1))
        top = np.zeros(n_docs)
        if len(x):
            top[some] = np.maximum.reduceat(x, first[some])
        out.append(top)
    return np.stack(out, 1)


class Classifier:
    def __init__(self, ratios: np.ndarray, features: np.ndarray, domain: np.ndarray, steps: int = 400):
        self.ratios = ratios
        self.mean, self.spread = np.zeros(features.shape[1]), np.ones(features.shape[1])
        self.weights = np.zeros((features.shape[1], len(DOMAINS)))
        self.off = np.zeros(len(DOMAINS))
        if len(domain):
            self.off = np.where(np.bincount(domain, minlength=len(DOMAINS)) > 0, 0.0, -1e9)
            self.mean[1:], self.spread[1:] = features[:, 1:].mean(0), features[:, 1:].std(0) + 1e-9
            x, want = (features - self.mean) / self.spread, np.eye(len(DOMAINS))[domain]
            speed = np.zeros_like(self.weights)
            for _ in range(steps):
                speed = 0.9 * speed + x.T @ (want - self._soft(x)) / len(x) - 1e-4 * self.weights
                self.weights += 0.3 * speed

    def _soft(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.weights + self.off
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def posteriors(self, features: np.ndarray) -> np.ndarray:
        return self._soft((features - self.mean) / self.spread)


def fit(docs: DataFrame, labels: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS) -> Classifier:
    spark = docs.sparkSession
    said = domain_of(labels)
    n = said.count()
    train = stable_sample(said, "doc_id", max_train_docs, n)
    train = train.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    known = docs.select("doc_id", "text").join(maybe_broadcast(train, min(n, 2 * max_train_docs)), "doc_id")
    once = known.groupBy("doc_id", "domain", "half").agg(F.min("text").alias("text"))  # an id trains once, however many rows it has
    texts = materialize(once.select("text", "domain", "half"), "mixing-train")
    counts = np.zeros(2 * len(DOMAINS) * BUCKETS)
    for row in map_text(texts, _count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():  # fixed size
        counts[row["at"]] = row["n"]
    counts = counts.reshape(2, len(DOMAINS), BUCKETS)
    halves = spark.sparkContext.broadcast(np.stack([log_ratios(counts[1]), log_ratios(counts[0])]))

    def features(batches):
        for batch in batches:
            half, domain = batch.column("half").to_numpy(zero_copy_only=False), batch.column("domain").to_numpy(zero_copy_only=False)
            for first, last, bucket, doc in _words(batch):
                both = [describe(bucket, doc, last - first, r) for r in halves.value]
                own = np.where((half[first:last] == 0)[:, None], both[0], both[1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(domain[first:last].astype(np.int32)), pa.array(list(own), pa.list_(pa.float64()))], names=["domain", "x"]
                )

    rows = map_text(texts, features, "domain int, x array<double>").collect()  # max_train_docs rows
    discard(texts)
    width = 1 + 2 * len(DOMAINS)
    x = np.array([r["x"] for r in rows]).reshape(-1, width)
    return Classifier(log_ratios(counts.sum(0)), x, np.array([r["domain"] for r in rows], np.int64))


def posteriors(docs: DataFrame, model: Classifier, keep: list[str]) -> DataFrame:
    """``keep`` columns, n_tokens and a posterior ``p_<domain>`` for every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            n, p = [], []
            for first, last, bucket, doc in _words(batch):
                n.append(np.bincount(doc, minlength=last - first))
                p.append(shared.value.posteriors(describe(bucket, doc, last - first, shared.value.ratios)))
            p = np.concatenate(p) if p else np.zeros((0, len(DOMAINS)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(np.concatenate(n).astype(np.int64) if n else np.zeros(0, np.int64)), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(DOMAINS)))],
                names=[*keep, "n_tokens", *(f"p_{d}" for d in DOMAINS)],
            )

    cols = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"))
    fresh = [T.StructField("n_tokens", T.LongType()), *(T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS)]
    return map_text(cols, run, T.StructType([*cols.schema.fields[:-1], *fresh]))


def rate_steps(shares: DataFrame, weights: dict[str, float], budget: float = 1.0, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """The steps of the projected gradient: for each one factor a domain.

    ``max(0, 1 - a y)``, ``a`` being a document's ``n p``, are the least-squares
    rates nearest to 1 for the ``y`` that minimises the convex
    ``sum(max(0, 1 - a y)^2) / 2 + y target + pull y^2 / 2``, so one step is
    enough once ``y`` is known.  It is found by Newton's method over the
    documents whose rate is above 0, with step lengths tried in one pass.  If
    the gradient is not within ``tolerance`` of all tokens after ``steps``
    passes, as many passes follow that step along the gradient by the inverse
    of the Gram matrix of all documents: it bounds the curvature everywhere, so
    no such step makes the value worse.  What is off then is logged.
    """
    k = len(DOMAINS)
    small = shares.select("n_tokens", *(f"p_{d}" for d in DOMAINS))
    names = ["half_square", *(f"t{i}" for i in range(k)), *(f"g{i}_{j}" for i in range(k) for j in range(k))]

    def at(points: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        sums = map_text(small, expected([list(map(float, y)) for y in points]), "point int, " + ", ".join(f"{x} double" for x in names))
        rows = {r["point"]: [float(r[x]) for x in names] for r in sums.groupBy("point").agg(*(F.sum(x).alias(x) for x in names)).collect()}  # len(points) rows
        return [(rows[i][0], np.array(rows[i][1 : 1 + k]), np.array(rows[i][1 + k :]).reshape(k, k)) for i in range(len(points))]

    row = small.agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("all")).first()
    total = float(row["all"] or 0)
    if not total:
        return []
    target = np.array([weights[d] for d in DOMAINS]) / sum(weights.values()) * total * budget
    pull = PULL * total * total / row["rows"]
    y = np.zeros(k)
    (value, totals, gram), length = at([y])[0], 1.0
    whole = gram + pull * np.eye(k)  # all rates are above 0 here, so no later Gram matrix is larger
    for i in range(2 * steps):
        slope = target - totals + pull * y
        if np.abs(slope).max() <= tolerance * total:
            return [[float(x) for x in y]] if y.any() else []
        newton = i < steps
        way = -np.linalg.solve(gram + pull * np.eye(k) if newton else whole, slope)
        points = [y + way * (length * 0.5**j if newton else 1.0) for j in range(TRIES if newton else 1)]
        found = at(points)
        values = [f[0] + target @ x + pull * (x @ x) / 2 for f, x in zip(found, points)]
        best = int(np.argmin(values))
        if values[best] < value or not newton:
            y, value, (_, totals, gram), length = points[best], values[best], found[best], 1.0
        else:
            length *= 0.5**TRIES
    off = dict(zip(DOMAINS, ((totals - target) / total).round(6).tolist()))
    LOG.warning("mixing: not within %g of the least squares after %d passes; totals less targets, as shares of all tokens: %s", tolerance, 2 * steps, off)
    return [[float(x) for x in y]] if y.any() else []


def expected(points: list[list[float]]):
    """Sums of each task under the rates of each of ``points``: half the squared rates, domain totals, Gram matrix of the rows with a rate above 0."""

    def run(batches):
        claim("mixing")
        k = len(DOMAINS)
        sums = np.zeros((len(points), 1 + k + k * k))
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
            a = np.stack([n * batch.column(f"p_{d}").to_numpy(zero_copy_only=False) for d in DOMAINS])
            for i, y in enumerate(points):
                r = np.maximum(0.0, 1.0 - np.asarray(y) @ a)
                live = a[:, r > 0]
                sums[i] += np.concatenate([[r @ r / 2], a @ r, (live @ live.T).ravel()])
        names = ["point", "half_square", *(f"t{i}" for i in range(k)), *(f"g{i}_{j}" for i in range(k) for j in range(k))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points), dtype=np.int32)), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], names=names)

    return run


def rate(taken: list[list[float]]) -> Column:
    """A document's rate after the given steps."""
    r = F.lit(1.0)
    for step in taken:
        r = F.greatest(F.lit(0.0), r - F.col("n_tokens") * sum((F.col(f"p_{d}") * x for d, x in zip(DOMAINS, step)), F.lit(0.0)))
    return r


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, budget: float = 1.0, max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """doc_id, source, domain (most likely), n_tokens, posteriors and rate for every document row."""
    model = fit(docs, labels, max_train_docs)
    shares = materialize(posteriors(docs, model, ["doc_id", "source"]), "mixing-shares")
    taken = rate_steps(shares, weights or WEIGHTS, budget)
    return with_rates(shares, taken)


def with_rates(shares: DataFrame, taken: list[list[float]]) -> DataFrame:
    p = [F.col(f"p_{d}") for d in DOMAINS]
    most = F.greatest(*p)
    domain = F.lit(DOMAINS[-1])
    for d in reversed(DOMAINS[:-1]):
        domain = F.when(F.col(f"p_{d}") == most, d).otherwise(domain)
    rest = [c for c in shares.columns if c not in ("n_tokens", *(f"p_{d}" for d in DOMAINS))]
    return shares.select(*rest, domain.alias("domain"), "n_tokens", *p, rate(taken).alias("rate"))


def sample(docs: DataFrame, labels: DataFrame, weights: dict[str, float] | None = None, whole: str = "clean", max_train_docs: int = MAX_TRAIN_DOCS) -> DataFrame:
    """The rows of ``docs`` that the rates keep, with the same columns.

    The budget is what leaves the tokens of ``whole`` as they are; documents
    most likely of that domain all stay, the others stay when a hash of their
    id and text, as a number in [0, 1), is below their rate.
    """
    weights = weights or WEIGHTS
    model = fit(docs, labels, max_train_docs)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    whole_rows = docs.select(F.struct(*docs.columns).alias("_doc"), draw.alias("_draw"), F.col("text").alias("text"))  # extra columns cannot clash
    shares = posteriors(whole_rows, model, ["_doc", "_draw"])
    light = materialize(posteriors(docs, model, ["doc_id"]).drop("doc_id"), "mixing-shares")
    have = light.agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens") * F.col(f"p_{whole}")).alias("k")).first()
    share = weights[whole] / sum(weights.values())
    budget = float(have["k"] or 0) / max(float(have["n"] or 0), 1.0) / share
    taken = rate_steps(light, weights, budget)
    discard(light)
    kept = with_rates(shares, taken).filter((F.col("domain") == whole) | (F.col("_draw") < F.col("rate")))
    return kept.select("_doc.*")

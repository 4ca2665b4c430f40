"""Language identification with language-bitmask n-gram filters.

Learning: character trigrams (lower case, everything but letters as a blank,
a letter in the middle) of the training documents are counted by language; a
trigram belongs to a language when its share of that language's trigrams is at
least ``min_rate``.  At most ``1 / min_rate`` trigrams a language can be, which
bounds the model.  A trigram's languages are one bit mask, stored in a
bit-sliced Bloom filter: slot arrays of 64-bit words, one bit a language, so
that one probe of ``n_hashes`` slots returns all languages at once.

Prediction: every trigram of the whole text is looked up; set bits are counted
by language; the count of language l is corrected for that language's false
positive rate f (share of its set slots to the power ``n_hashes``) as
``(count - n f) / (1 - f)``.  The largest corrected count wins, the score is
its share of the document's trigrams.

Training rows are a bounded sample (``max_train_docs``, chosen by a hash of
``doc_id``) of the rows that may be learned from: all rows of rare languages,
and alike many of each of the others.

Defined results
---------------
* null text, or no letter: ``und`` with score 0.
* nothing learned (no training row): ``und`` with score 0 everywhere.
* ties between languages: the smaller name.
* null ``doc_id``: predicted, not held out, never learned from.
* repeated rows: one output row for each.  Extra columns are ignored.
* any number of languages: the masks take as many 64-bit words as needed.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm.tables import discard, map_text, materialize
from cladeframe.llm.textnum import BLOCK_BYTES, claim, mix

MAX_TRAIN_DOCS = 50_000
MIN_RATE = 1e-4
N_HASHES = 4
BITS_PER_GRAM = 12


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    """For every code point: whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code, document) of the trigrams of every text; a code is exact, 21 bits a character."""
    low = [(t or "").lower() for t in texts]
    code, middle = _codes(" " + " ".join(low) + " ")
    ends = np.cumsum([len(t) + 1 for t in low])
    return code, np.searchsorted(ends, middle - 1, side="right")


def _codes(joined: str) -> tuple[np.ndarray, np.ndarray]:
    """(code, place of the middle character) of the trigrams within a string that starts and ends with a character of context."""
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    plain = np.where(letter, points, 32).astype(np.uint64)
    middle = np.flatnonzero(letter[1:-1]) + 1
    return plain[middle - 1] | (plain[middle] << np.uint64(21)) | (plain[middle + 1] << np.uint64(42)), middle


def gram_slices(texts: list[str]):
    """The trigrams of all texts as in :func:`trigrams`; long texts come in slices of BLOCK_BYTES characters."""
    if sum(len(t or "") for t in texts) <= 2 * BLOCK_BYTES:
        yield trigrams(texts)
        return
    for d, text in enumerate(texts):
        padded = " " + (text or "").lower() + " "
        for lo in range(0, len(padded) - 2, BLOCK_BYTES):
            code, _ = _codes(padded[lo : lo + BLOCK_BYTES + 2])
            yield code, np.full(len(code), d, np.int64)


def _text_blocks(column: pa.Array):
    """(first row, texts) of runs of rows of about BLOCK_BYTES together."""
    first, size, held = 0, 0, []
    for i, v in enumerate(column):
        t = v.as_py() or ""
        held.append(t)
        size += len(t)
        if size >= BLOCK_BYTES:
            yield first, held
            first, size, held = i + 1, 0, []
    if held:
        yield first, held


def _count_grams(batches):
    claim("language")
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for first, texts in _text_blocks(batch.column("text")):
            block = langs[first : first + len(texts)]
            for code, doc in gram_slices(texts):
                for lang in sorted(set(block)):
                    grams, n = np.unique(code[(block == lang)[doc]], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n.astype(np.int64))],
                        names=["lang", "gram", "n"],
                    )


class LanguageFilter:
    """Bit-sliced Bloom filter from trigram codes to sets of languages."""

    def __init__(self, grams: dict[str, np.ndarray], n_hashes: int = N_HASHES, bits_per_gram: int = BITS_PER_GRAM):
        self.langs = sorted(grams)
        self.n_hashes = n_hashes
        most = max((len(g) for g in grams.values()), default=1)
        self.size = 1 << max(10, int(np.ceil(np.log2(max(1, most) * bits_per_gram))))
        self.slots = np.zeros(((len(self.langs) + 63) // 64, self.size), np.uint64)
        for i, lang in enumerate(self.langs):
            word, bit = divmod(i, 64)
            for at in self._probes(np.asarray(grams[lang], np.uint64)):
                self.slots[word, at] |= np.uint64(1 << bit)
        fill = [((self.slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.langs))]
        self.false_rate = np.array(fill) ** n_hashes

    def _probes(self, code: np.ndarray):
        h = mix(code)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for j in range(self.n_hashes):
            yield ((h + np.uint64(j) * step) & np.uint64(self.size - 1)).astype(np.int64)

    def masks(self, code: np.ndarray) -> np.ndarray:
        """The languages of every code: one row of bits a mask word."""
        out = None
        for at in self._probes(code):
            out = self.slots[:, at] if out is None else out & self.slots[:, at]
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs:
            return ["und"] * n, np.zeros(n)
        total, counts = np.zeros(n), np.zeros((len(self.langs), n))
        for code, doc in gram_slices(texts):
            total += np.bincount(doc, minlength=n)
            masks = self.masks(code)
            for i in range(len(self.langs)):
                bits = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                counts[i] += np.bincount(doc, weights=bits, minlength=n)
        f = self.false_rate[:, None]
        fixed = np.clip((counts - total * f) / np.maximum(1 - f, 1e-9), 0, None)
        best = fixed.argmax(0)
        score = np.where(total > 0, fixed.max(0) / np.maximum(total, 1), 0.0)
        return [self.langs[b] if t else "und" for b, t in zip(best, total)], np.clip(score, 0, 1)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def sample_by_language(usable: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` rows by a hash of the id: all rows of rare languages, alike many of each other one."""
    found = [(r["lang"], r["count"]) for r in usable.groupBy("lang").count().collect()]  # a row a language
    left = bound
    if sum(n for _, n in found) <= bound:
        return usable
    shares = []
    for k, (lang, n) in enumerate(sorted(found, key=lambda x: (x[1], x[0]))):
        take = min(n, left / (len(found) - k))
        left -= take
        shares.append((lang, int(take / n * (1 << 30))))
    table = usable.sparkSession.createDataFrame(shares, "lang string, share long")
    chosen = usable.join(F.broadcast(table), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share"))
    return chosen.select(*usable.columns)


def fit(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, min_rate: float = MIN_RATE) -> LanguageFilter:
    usable = docs.filter((fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    train = sample_by_language(usable, max_train_docs)
    parts = map_text(train.select("text", "lang"), _count_grams, "lang string, gram bigint, n bigint")
    counts = materialize(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "lang-grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= min_rate * F.col("total"))  # a row a language
    grams: dict[str, list[int]] = {}
    for row in kept.select("lang", "gram").toLocalIterator():  # at most 1 / min_rate rows a language
        grams.setdefault(row["lang"], []).append(row["gram"])
    discard(counts)
    return LanguageFilter({k: np.array(v, np.int64).astype(np.uint64) for k, v in grams.items()})


def predict(docs: DataFrame, model: LanguageFilter, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2 * bits_per_gram / min_rate slots

    def run(batches):
        claim("language")
        m = shared.value
        for batch in batches:
            names, scores = [], []
            for _, texts in _text_blocks(batch.column("_text")):
                got, s = m.predict(texts)
                names += got
                scores.append(s)
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                names=[*keep, "lang_pred", "score"],
            )

    cols = docs.select(*keep, F.col("text").alias("_text"))
    schema = T.StructType([*cols.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return map_text(cols, run, schema)


def identify(docs: DataFrame, max_train_docs: int = MAX_TRAIN_DOCS, min_rate: float = MIN_RATE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document row."""
    model = fit(docs, max_train_docs, min_rate)
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return predict(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])

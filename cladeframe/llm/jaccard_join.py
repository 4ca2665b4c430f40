"""Exact Jaccard self-join on word shingles by rare-first prefix filtering.

A document's set holds its distinct 4-word shingles (64-bit hashes).  Sets
that are equal are one *class* from the start, named by a hash of the set;
only classes meet each other.

1. Sketch: all shingles are counted in ``2**sketch_bits`` buckets, merged by
   chunk.  The order (bucket count, hash) is one total order for all
   documents, rare shingles first; its size does not grow with the corpus.
2. Prefix index: with overlap at least ``ceil(t n)`` two linked sets share one
   of the first ``n - ceil(t n) + 1`` shingles of that order, so only these
   are indexed, with position and set size.  Most are in one prefix only.  A
   first pass over the texts therefore sends no index rows but packed, sorted
   48-bit tokens, each at most twice a flush, and sets a bit of a map of fixed
   size for every token met twice; the second pass writes index rows of tokens
   whose bit is set, and lists of one class drop out.  A full map would let
   more rows pass, never lose one.
3. Rounds: the members of an index list are not paired with each other.  Each
   member first meets one hub (the smallest class of a list; the hub with most
   common prefix shingles), verified pairs are contracted to components, and
   lists whose members are in one component by then are settled.  A second
   round picks other hubs.  What is left is done in full.  Lists of at most
   ``SHORT_LIST`` classes yield the pairs of different components.  Longer
   lists are cut into blocks of bounded size; two blocks meet in one task,
   which gets all intersections at once as a product of incidence matrices and
   returns a spanning set of the links only: each block by itself first, then,
   for the lists that still span several components, the pairs of blocks.  Lists with equal members are
   done once.  No link between different components can be missed, and copies
   are never expanded into all pairs.
4. Every pair passes the length filter, the positional filter (common prefix
   shingles plus what can follow the last of them) and the suffix filter (the
   sets' counts over a fixed partition of the shingle space bound the Hamming
   distance), and is verified once by intersecting the whole sets.  A hub's
   partners are dealt over tasks in groups of at most ``HUB_ROWS``, so that no
   class, however many meet it, is one task's work.

Defined results
---------------
* null or empty text, or no words: ``n_shingles`` 0, own component.
* fewer than four words: the whole sequence is the one shingle.
* repeated rows and rows that share a ``doc_id``: a row each; rows of one id
  stay in the components of their own texts.
* null ``doc_id``: linked like others, the component is named by the smallest
  id that is not null (null if there is none).
* empty table: empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cladeframe.llm.components import connected_components
from cladeframe.llm.tables import discard, fits_broadcast, map_text, materialize, maybe_broadcast, tidy
from cladeframe.llm.textnum import blocks, claim, lower_ascii, mix, span_hashes, words

WIDTH = 4
#: A link needs PERCENT * union <= 100 * intersection.
PERCENT = 85
SKETCH_BITS = 22
_CHUNK = 1 << 16
#: Parts of the shingle space that the suffix filter counts over.
PARTS = 32
SHORT_LIST = 32
HUB_VOTES = 3
#: Bytes of a class with its part counts.
PART_BYTES = 100
#: Partners of one class that meet it in one task.
HUB_ROWS = 500
#: Bits of a token in the first pass, of the map's size, and tokens of one flush and of one part of the merge.
TOKEN_BITS = 48
MAP_BITS = 27
FLUSH_TOKENS = 500_000
PART_TOKENS = 4_000_000
#: Bounds of a block of a longer list: shingles and sets.
BLOCK_SHINGLES = 400_000
BLOCK_SETS = 2_000
_SEEDS = (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every document of a block."""
    low = lower_ascii(data)
    starts, ends, doc = words(low, offs)
    h = span_hashes(low, starts, ends)
    n_docs = len(offs) - 1
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    if len(h) >= width:
        rolled = np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            rolled = mix(rolled * np.uint64(31) + h[j : len(h) - width + 1 + j] * np.uint64(_SEEDS[j % 4]) + np.uint64(j))
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for d in range(n_docs):
        a, b = first[d], first[d + 1]
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                whole = mix(whole * np.uint64(_SEEDS[0]) ^ x)
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(s: np.ndarray) -> int:
    """64-bit name of a set, the same for equal sets."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        a = mix(s ^ np.uint64(_SEEDS[0])).sum(dtype=np.uint64)
        b = np.bitwise_xor.reduce(mix(s + np.uint64(_SEEDS[1])))
        return int(mix(np.array([a * np.uint64(_SEEDS[2] | 1) + b * np.uint64(3) + np.uint64(len(s))], np.uint64))[0].astype(np.int64))


def part_counts(s: np.ndarray) -> np.ndarray:
    """Shingles in each part of the shingle space, cut off at the largest short: differences of these never exceed the true ones."""
    return np.minimum(np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=PARTS), 32767).astype(np.int16)


def _least(n, percent):
    """ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _survey(width: int, sketch_bits: int):
    """Class and size of every document, then this task's sketch in chunks."""

    def run(batches):
        claim("jaccard")
        sketch = np.zeros(1 << sketch_bits, np.uint8)
        shift = np.uint64(64 - sketch_bits)
        for batch in batches:
            names, sizes, parts = [], [], []
            for _, _, data, offs in blocks(batch.column("text")):
                sets = shingle_sets(data, offs, width)
                names += [set_name(s) for s in sets]
                sizes += [len(s) for s in sets]
                parts += [part_counts(s) for s in sets]
                at, n = np.unique(np.concatenate(sets) >> shift, return_counts=True)
                at = at.astype(np.int64)
                sketch[at] = np.minimum(sketch[at].astype(np.int64) + n, 255)
            k = len(names)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, k * PARTS + 1, PARTS, dtype=np.int32)), pa.array(np.concatenate([*parts, np.zeros(0, np.int16)]))),
                    pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()),
                ],
                names=["doc_id", "cls", "n", "parts", "chunk", "counts"],
            )
        for c in range(0, len(sketch), _CHUNK):
            part = sketch[c : c + _CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.list_(pa.int16())),
                        pa.array([c // _CHUNK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary()),
                    ],
                    names=["doc_id", "cls", "n", "parts", "chunk", "counts"],
                )

    return run


def _merge_chunks(batches):
    """Sums of equal chunks, as logarithms of one byte; each chunk comes to one task."""
    claim("jaccard")
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, z in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
            part = np.frombuffer(zlib.decompress(z), np.uint8)
            held[c] = held[c] + part if c in held else part.astype(np.uint32)
    for c, n in held.items():
        level = np.minimum(np.round(8 * np.log2(1.0 + n)), 255).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "levels"])


def _prefix(s: np.ndarray, percent: int, levels: np.ndarray, shift) -> np.ndarray:
    """Places in ``s`` of its rarest shingles, rarest first."""
    level = levels[(s >> shift).astype(np.int64)]
    return np.argsort(level, kind="stable")[: len(s) - _least(len(s), percent) + 1]  # s is sorted, so ties go by hash


def pack(tokens: np.ndarray) -> bytes:
    """Sorted tokens as compressed differences, byte by byte."""
    gaps = np.diff(tokens, prepend=np.uint64(0)).astype("<u8")
    return zlib.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, : TOKEN_BITS // 8].T).tobytes(), 1)


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(TOKEN_BITS // 8, -1)
    gaps = np.zeros((planes.shape[1], 8), np.uint8)
    gaps[:, : TOKEN_BITS // 8] = planes.T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _packed_tokens(width: int, percent: int, sketch_bits: int, sketch, part_bits: int):
    """(part, packed) of the prefix tokens, cut to TOKEN_BITS; one that a flush holds several times is there twice."""

    def run(batches):
        claim("jaccard")
        levels = np.frombuffer(sketch.value, np.uint8)
        shift = np.uint64(64 - sketch_bits)
        held, total = [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            tokens = np.repeat(tokens, np.minimum(n, 2))
            part = (tokens >> np.uint64(TOKEN_BITS - part_bits)).astype(np.int64)
            at = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            for lo in range(0, len(at) - 1, 1000):
                some = range(lo, min(lo + 1000, len(at) - 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(part[at[i]]) for i in some], pa.int64()), pa.array([pack(tokens[at[i] : at[i + 1]]) for i in some], pa.binary())], names=["part", "packed"]
                )

        for batch in batches:
            for _, _, data, offs in blocks(batch.column("text")):
                for s in shingle_sets(data, offs, width):
                    if len(s):
                        held.append(s[_prefix(s, percent, levels, shift)] >> np.uint64(64 - TOKEN_BITS))
                        total += len(held[-1])
                if total >= FLUSH_TOKENS:
                    yield from flush()
                    held, total = [], 0
        if held:
            yield from flush()

    return run


def _mark(part_bits: int, map_bits: int):
    """The pieces of the bit map of a task's parts: a bit for every token that is there twice."""

    def run(batches):
        claim("jaccard")
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, packed in zip(batch.column("part").to_pylist(), batch.column("packed").to_pylist()):
                held.setdefault(part, []).append(packed)
        for part in list(held):
            tokens = np.sort(np.concatenate([unpack(x) for x in held.pop(part)]))
            twice = tokens[1:][tokens[1:] == tokens[:-1]]
            bits = np.zeros(1 << (map_bits - part_bits), np.uint8)
            bits[((twice >> np.uint64(TOKEN_BITS - map_bits)) & np.uint64((1 << (map_bits - part_bits)) - 1)).astype(np.int64)] = 1
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())], names=["part", "bits"])

    return run


def _prefixes(width: int, percent: int, sketch_bits: int, sketch, map_bits: int, seen):
    """Index entries of the rarest shingles of every document that the bit map does not rule out."""

    def run(batches):
        claim("jaccard")
        levels, bits = np.frombuffer(sketch.value, np.uint8), np.frombuffer(seen.value, np.uint8)
        shift = np.uint64(64 - sketch_bits)
        for batch in batches:
            for _, _, data, offs in blocks(batch.column("text")):
                tokens, names, sizes, places = [], [], [], []
                for s in shingle_sets(data, offs, width):
                    if not len(s):
                        continue
                    token = s[_prefix(s, percent, levels, shift)]
                    at = (token >> np.uint64(64 - map_bits)).astype(np.int64)
                    place = np.flatnonzero(bits[at >> 3] & (128 >> (at & 7)))
                    if len(place):
                        tokens.append(token[place].astype(np.int64))
                        names.append(np.full(len(place), set_name(s), np.int64))
                        sizes.append(np.full(len(place), len(s), np.int64))
                        places.append(place.astype(np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (tokens, names, sizes, places)], names=["token", "cls", "n", "pos"]
                    )

    return run


def _whole_sets(width: int):
    """The whole set of every document."""

    def run(batches):
        claim("jaccard")
        for batch in batches:
            for _, _, data, offs in blocks(batch.column("text")):
                sets = shingle_sets(data, offs, width)
                at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_name(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets).astype(np.int64)))],
                    names=["cls", "shingles"],
                )

    return run


def block_links(cls: np.ndarray, root: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join the roots of the given classes: a spanning set, no pair within a root."""
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    shingle, code, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = seen[code] > 1  # a shingle of one set is in no intersection
    owner, code = owner[often], code[often]
    by = np.argsort(code, kind="stable")
    owner, code = owner[by], code[by]
    column = np.cumsum(np.concatenate([[0], np.diff(code) > 0])) if len(code) else code
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        a, b = np.searchsorted(column, [lo, lo + 1024])
        part = np.zeros((len(sets), 1024), np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        for i in range(0, len(sets), 256):
            common[i : i + 256] += part[i : i + 256] @ part.T
    _, group = np.unique(root, return_inverse=True)
    lead = list(range(int(group.max(initial=0)) + 1))

    def top(x: int) -> int:
        while lead[x] != x:
            lead[x] = lead[lead[x]]
            x = lead[x]
        return x

    out = []
    for i in range(len(sets)):
        fits = ((100 + percent) * common[i].astype(np.float64) >= percent * (n[i] + n)) & (group > group[i])
        for j in np.flatnonzero(fits):
            a, b = top(group[i]), top(group[j])
            if a != b:
                lead[b] = a
                out.append((int(cls[i]), int(cls[j])))
    return out


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int, sketch_bits: int):
        self.docs = docs.select("doc_id", "text")
        self.spark = docs.sparkSession
        self.width, self.percent, self.sketch_bits = width, percent, sketch_bits
        self.passing: list[DataFrame] = []

    def enough(self, common, n, m):
        """Whether ``common`` shingles can make a link of sets of n and m."""
        return (100 + self.percent) * common >= self.percent * (n + m)

    def survey(self) -> None:
        schema = "doc_id bigint, cls bigint, n bigint, parts array<smallint>, chunk int, counts binary"
        survey = materialize(map_text(self.docs, _survey(self.width, self.sketch_bits), schema), "jaccard-survey")
        rows = survey.filter("chunk is null")
        chunks = survey.filter("chunk is not null").select("chunk", "counts")
        merged = chunks.repartition(64, "chunk").mapInArrow(_merge_chunks, "chunk int, levels binary")
        levels = np.zeros(1 << self.sketch_bits, np.uint8)
        for row in merged.toLocalIterator():  # the sketch's fixed size
            levels[row["chunk"] * _CHUNK :][:_CHUNK] = np.frombuffer(row["levels"], np.uint8)
        self.sketch = self.spark.sparkContext.broadcast(levels.tobytes())
        self.meta = materialize(rows.select("doc_id", "cls", "n"), "jaccard-meta")
        self.parts = materialize(rows.select("cls", "parts"), "jaccard-parts")
        discard(survey)

    def index(self) -> None:
        """(token, cls, n, pos, hub) of the lists with more than one class."""
        firsts = self.meta.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("k"))
        many = materialize(firsts.filter("k > 1").select("cls", F.col("doc_id").alias("first")), "jaccard-many")
        known = self.meta.join(maybe_broadcast(many, many.count()), "cls", "left").groupBy("doc_id").agg(
            F.min(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).alias("copy"), F.count(F.lit(1)).alias("k")
        )
        #: ids whose rows are all copies of an earlier id's, and ids of several rows
        self.odd = materialize(known.filter("copy or k > 1"), "jaccard-odd")
        discard(many)
        copies = self.odd.filter("copy").select("doc_id")
        self.n_again = self.odd.filter("not copy").count()
        tidy(self.spark)
        own = self.texts(None, copies, copies.count())
        total = self.meta.agg(F.sum("n")).first()[0] or 0
        total = total * (100 - self.percent) // 100
        part_bits = min(MAP_BITS - 3, max(6, int(-(-total // PART_TOKENS)).bit_length()))
        packed = map_text(own, _packed_tokens(self.width, self.percent, self.sketch_bits, self.sketch, part_bits), "part bigint, packed binary")
        marks = packed.repartition(1 << part_bits, "part").mapInArrow(_mark(part_bits, MAP_BITS), "part bigint, bits binary")
        bits = bytearray(1 << (MAP_BITS - 3))
        piece = 1 << (MAP_BITS - 3 - part_bits)
        for row in marks.toLocalIterator():  # the map's fixed size
            bits[row["part"] * piece : (row["part"] + 1) * piece] = zlib.decompress(row["bits"])
        seen = self.spark.sparkContext.broadcast(bits)
        del bits
        entries = map_text(own, _prefixes(self.width, self.percent, self.sketch_bits, self.sketch, MAP_BITS, seen), "token bigint, cls bigint, n bigint, pos int")
        entries = materialize(entries, "jaccard-entries")
        seen.destroy()
        self.sketch.destroy()
        lists = entries.groupBy("token").agg(F.min("cls").alias("hub"), F.max("cls").alias("last")).filter("hub != last").select("token", "hub")
        lists = materialize(lists, "jaccard-lists")
        self.n_lists = lists.count()
        self.shared = materialize(entries.join(maybe_broadcast(lists, self.n_lists), "token"), "jaccard-shared")
        discard(entries, lists)
        tidy(self.spark)
        used = materialize(self.shared.select("cls").distinct(), "jaccard-used")
        self.n_classes = used.count()
        some = maybe_broadcast(used, self.n_classes, 8)
        parts = self.parts.join(some, "cls", "left_semi").groupBy("cls").agg(F.first("parts").alias("parts"))
        self.classes = materialize(parts.join(self.meta.join(some, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "cls"), "jaccard-classes")
        discard(used, self.parts)

    def texts(self, ids, copies=None, n: int = 0) -> DataFrame:
        """The texts of the documents of ``ids`` (all without it) and of no id of ``copies``; of repeated and of null ids each text once."""
        keep = lambda df: df if ids is None else df.join(ids, "doc_id", "left_semi")
        rows = keep(self.docs.filter("doc_id is not null"))
        if not self.n_again:
            return (rows if copies is None else rows.join(maybe_broadcast(copies, n, 8), "doc_id", "left_anti")).select("text")
        again = self.odd.filter("not copy").select("doc_id")
        apart = maybe_broadcast(again if copies is None else self.odd.select("doc_id"), self.n_again + n, 8)
        several = keep(self.docs.filter("doc_id is not null").join(maybe_broadcast(again, self.n_again, 8), "doc_id", "left_semi"))
        several = several.select("text").union(self.docs.filter("doc_id is null").select("text"))
        return rows.join(apart, "doc_id", "left_anti").select("text").union(several.dropDuplicates(["text"]))

    def apart(self, x, y):
        """Lower bound of the Hamming distance of two sets from their part counts."""
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p - q).cast("int")), F.lit(0), lambda s, d: s + d)

    def filtered(self, pairs: DataFrame, least_votes: int = 1) -> DataFrame:
        """(a, b, n, m, votes) from rows (a, n, pos, b, m, pos_b): length, positional and suffix filter.

        The rounds with hubs ask for ``HUB_VOTES`` common prefix shingles, which
        spares them chance meetings; what they pass over is left to the last
        rounds, which take every pair.
        """
        n, m = F.col("n"), F.col("m")
        close = pairs.filter((100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & (F.col("a") != F.col("b")))
        grouped = close.groupBy("a", "b").agg(
            F.count(F.lit(1)).alias("votes"), F.first("n").alias("n"), F.first("m").alias("m"), F.max("pos").alias("pos"), F.max("pos_b").alias("pos_b")
        )
        rest = F.least(n - F.col("pos"), m - F.col("pos_b")) - 1
        placed = grouped.filter(self.enough(F.col("votes") + rest, n, m) & (F.col("votes") >= least_votes))
        x = self.classes.select(F.col("cls").alias("a"), F.col("parts").alias("parts_a"))
        y = self.classes.select(F.col("cls").alias("b"), F.col("parts").alias("parts_b"))
        if fits_broadcast(self.n_classes, PART_BYTES):
            both = placed.join(F.broadcast(x), "a").join(F.broadcast(y), "b")
        else:
            self.passing.append(materialize(placed, "jaccard-placed"))
            both = self.spread(self.passing[-1].join(x, "a"), y)
        return both.filter(self.enough((n + m - self.apart("parts_a", "parts_b")) / 2, n, m)).select("a", "b", "n", "m", "votes")

    def spread(self, pairs: DataFrame, others: DataFrame) -> DataFrame:
        """``pairs`` joined with the rows (b, ...) of ``others``; the rows of a class ``b`` in many pairs are copied to several tasks."""
        hot = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("cuts")).filter("cuts > 1"), "jaccard-hot")
        self.passing.append(hot)
        n = hot.count()
        if not n:
            return pairs.join(others, "b")
        cuts = F.coalesce("cuts", F.lit(1))
        dealt = pairs.join(maybe_broadcast(hot, n), "b", "left").withColumn("salt", F.pmod(F.xxhash64("a"), cuts)).drop("cuts")
        copied = others.join(maybe_broadcast(hot, n), "b", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), cuts - 1)).cast("bigint")).drop("cuts")
        return dealt.join(copied, ["b", "salt"]).drop("salt")

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(cls, shingles) of the wanted classes (cls), made from their texts; a class of a repeated id may come more than once, and others with it."""
        ids = materialize(self.classes.join(wanted.distinct(), "cls").select("doc_id").distinct(), "jaccard-wanted")
        self.passing.append(ids)
        texts = self.texts(maybe_broadcast(ids, ids.count(), 8))
        return map_text(texts, _whole_sets(self.width), "cls bigint, shingles array<bigint>")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The links (a, b) among candidate ``pairs``: the set of ``a`` travels once a pair, that of ``b`` once a group of its partners."""
        pairs = materialize(pairs, f"jaccard-{name}")
        self.settle()
        n = pairs.count()
        own = self.sets(pairs.select(F.col("a").alias("cls"))).select(F.col("cls").alias("a"), F.col("shingles").alias("set_a"))
        others = self.sets(pairs.select(F.col("b").alias("cls"))).select(F.col("cls").alias("b"), F.col("shingles").alias("set_b"))
        hot = materialize(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).cast("int").alias("cuts")), "jaccard-hubs")
        hubs = maybe_broadcast(hot, hot.count())
        dealt = pairs.join(hubs, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("cuts")).cast("int")).drop("cuts")
        left = own.join(maybe_broadcast(dealt, n, 40), "a")
        right = others.join(hubs, "b").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).drop("cuts")
        common = F.size(F.array_intersect("set_a", "set_b"))
        met = left.join(right.hint("shuffle_merge"), ["b", "salt"])
        links = materialize(met.filter(self.enough(common, F.col("n"), F.col("m"))).select("a", "b"), f"jaccard-{name}-links")
        discard(pairs, hot)
        self.settle()
        return links

    def settle(self) -> None:
        """Delete the tables that the last written one was made from."""
        discard(*self.passing)
        self.passing.clear()

    def components(self) -> DataFrame:
        """(cls, root) of the classes that have a link."""
        own = F.col("cls")
        hubs = self.shared.filter("cls = hub").select("token", F.col("n").alias("m"), F.col("pos").alias("pos_b")).dropDuplicates(["token"])
        hubbed = self.shared.join(maybe_broadcast(hubs, self.n_lists, 24), "token").select(own.alias("a"), "n", "pos", F.col("hub").alias("b"), "m", "pos_b")
        best = (
            self.filtered(hubbed, HUB_VOTES).groupBy("a")
            .agg(F.max(F.struct("votes", (-F.xxhash64("b")).alias("h"), "b", "n", "m")).alias("x"))
            .select("a", "x.b", "x.n", "x.m")
        )
        self.links = self.verified(best, "first")
        self.contract()
        open_rows = self.unsettled()
        hub = F.min_by(F.struct("cls", "n", "pos", "root"), F.xxhash64("cls", "n"))
        others = materialize(open_rows.groupBy("token").agg(hub.alias("h")), "jaccard-others")
        self.passing.append(others)
        pairs = open_rows.join(maybe_broadcast(others, others.count(), 48), "token").filter(F.col("root") != F.col("h.root")).select(
            own.alias("a"), "n", "pos", F.col("h.cls").alias("b"), F.col("h.n").alias("m"), F.col("h.pos").alias("pos_b")
        )
        self.add(self.verified(self.filtered(pairs, HUB_VOTES).select("a", "b", "n", "m"), "second"))
        discard(open_rows)
        open_rows = self.unsettled()
        sizes = self.sizes(open_rows)
        few = sizes.filter(F.col("k") <= SHORT_LIST).select("token")
        short = open_rows.join(maybe_broadcast(few, few.count(), 8), "token")
        self.add(self.verified(self.filtered(self.short_pairs(short)).select("a", "b", "n", "m"), "short"))
        long = self.long_lists(sizes)
        if not long.isEmpty():
            self.add(self.long_links(open_rows, long, False))
            if not long.filter("cuts > 1").isEmpty():
                discard(open_rows, sizes)
                open_rows = self.unsettled()
                sizes = self.sizes(open_rows)
                long = self.long_lists(sizes).filter("cuts > 1")
                if not long.isEmpty():
                    self.add(self.long_links(open_rows, long, True))
        discard(open_rows, sizes, self.shared, self.classes)
        return self.roots.select(F.col("node").alias("cls"), "root")

    def sizes(self, rows: DataFrame) -> DataFrame:
        """Members, shingles and a hash of the members of every open list."""
        return materialize(
            rows.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"), F.sum(F.xxhash64("cls").cast("decimal(20,0)")).alias("who")),
            "jaccard-open-lists",
        )

    def long_lists(self, sizes: DataFrame) -> DataFrame:
        cuts = F.ceil(F.greatest(F.col("all") / BLOCK_SHINGLES, F.col("k") / BLOCK_SETS)).cast("int")
        return sizes.filter(F.col("k") > SHORT_LIST).withColumn("cuts", cuts)

    def contract(self) -> None:
        tidy(self.spark)
        old = getattr(self, "roots", None)
        self.roots = connected_components(self.links, "a", "b", "jaccard")
        if old is not None:
            discard(old)

    def add(self, more: DataFrame) -> None:
        if not more.isEmpty():
            self.links = self.links.union(more)
            self.contract()

    def short_pairs(self, rows: DataFrame) -> DataFrame:
        """The pairs of different components within short lists: at most SHORT_LIST rows for a row."""
        known = rows.join(self.classes.select("cls", "parts"), "cls")
        x, y = known.alias("x"), known.alias("y")
        n, m = F.col("x.n"), F.col("y.n")
        ahead = F.least("x.pos", "y.pos") + F.least(n - F.col("x.pos"), m - F.col("y.pos"))
        fits = (
            (F.col("x.token") == F.col("y.token")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root"))
            & (100 * F.least(n, m) >= self.percent * F.greatest(n, m)) & self.enough(ahead, n, m)
            & self.enough((n + m - self.apart("x.parts", "y.parts")) / 2, n, m)
        )
        return x.join(y, fits).select(
            F.col("x.cls").alias("a"), n.alias("n"), F.col("x.pos").alias("pos"), F.col("y.cls").alias("b"), m.alias("m"), F.col("y.pos").alias("pos_b")
        )

    def long_links(self, rows: DataFrame, lists: DataFrame, apart: bool) -> DataFrame:
        """Links between the components of long lists, within each block of a list or, ``apart``, between two of its blocks."""
        once = lists.groupBy("who", "k", "all", "cuts").agg(F.min("token").alias("token")).select("token", "cuts")
        once = materialize(once, "jaccard-long")
        members = rows.join(once, "token").select("token", "cls", "root", "cuts").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("cuts")).cast("int"))
        members = materialize(members, "jaccard-members")
        if apart:
            sent = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).filter("own != other")
        else:
            sent = members.withColumn("other", F.col("own"))
        sent = sent.select("token", "cls", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        percent = self.percent

        def meet(table):
            claim("jaccard")
            held = [x.values.to_numpy()[a:b] for x in table.column("shingles").chunks for a, b in zip(x.offsets.to_numpy()[:-1], x.offsets.to_numpy()[1:])]
            out = np.array(block_links(table.column("cls").to_numpy(), table.column("root").to_numpy(), held, percent), np.int64).reshape(-1, 2)
            return pa.table({"a": np.ascontiguousarray(out[:, 0]), "b": np.ascontiguousarray(out[:, 1])})

        sets = materialize(self.sets(members.select("cls")), "jaccard-sets")
        tasks = sent.join(sets.dropDuplicates(["cls"]), "cls").select("token", "i", "j", "cls", "root", "shingles")
        links = materialize(tasks.groupBy("token", "i", "j").applyInArrow(meet, "a bigint, b bigint"), "jaccard-long-links")
        discard(sets, once, members)
        self.settle()
        return links

    def unsettled(self) -> DataFrame:
        """The rows of ``shared`` in lists that span more than one component."""
        roots = self.roots.select(F.col("node").alias("cls"), "root")
        known = self.shared.select("token", "cls", "n", "pos").join(maybe_broadcast(roots, roots.count()), "cls", "left")
        known = known.withColumn("root", F.coalesce("root", "cls"))
        spans = known.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("token")
        spans = materialize(spans, "jaccard-spans")
        rows = materialize(known.join(maybe_broadcast(spans, spans.count()), "token"), "jaccard-open")
        discard(spans)
        return rows


def _classes(keep: str, width: int):
    def run(batches):
        claim("jaccard")
        for batch in batches:
            names = [set_name(s) for _, _, data, offs in blocks(batch.column("text")) for s in shingle_sets(data, offs, width)]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(names, pa.int64())], names=[keep, "cls"])

    return run


def with_class(docs: DataFrame, keep: str, width: int = WIDTH) -> DataFrame:
    """Column ``keep`` and the class of the text (0: no words) of every row."""
    cols = docs.select(keep, F.coalesce("text", F.lit("")).alias("text"))
    return map_text(cols, _classes(keep, width), T.StructType([cols.schema[keep], T.StructField("cls", T.LongType())]))


def labelled_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, cls, n) of every document row; (cls, component_id, first_cls) of every class of a component of two rows or more.

    ``first_cls`` is the component's class that holds its smallest id, the
    smallest of these; with null ids only the smallest of all.
    """
    job = _Join(docs, width, percent, sketch_bits)
    job.survey()
    job.index()
    roots = job.components()
    firsts = job.meta.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k"))
    named = firsts.join(roots, "cls", "left").filter("k > 1 or root is not null").withColumn("root", F.coalesce("root", "cls"))
    lowest = named.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "cls")).alias("low"))
    lowest = lowest.select("root", F.col("low.first").alias("component_id"), F.col("low.cls").alias("first_cls"))
    return job.meta, materialize(named.join(lowest, "root").select("cls", "component_id", "first_cls"), "jaccard-labels")


def jaccard_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n_shingles, component_id for every document row."""
    meta, labels = labelled_classes(docs, width, percent, sketch_bits)
    found = meta.join(maybe_broadcast(labels.select("cls", "component_id"), labels.count()), "cls", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))

"""Merkle fixity audit of WARC replicas.

Pages are rendered as WARC response records, which carry an id of their own,
and laid out in files.  A replica is known by its records' file, range, id,
offset, length and digest, the digest being SHA-256 of the record's bytes.

A file's records, in offset order, fall into ``RANGES`` ranges.  A range's hash
covers length and digest of its records with their offsets from the *start of
the range*, so a lost or longer record changes its own range and not those
behind it.  A file's hash covers its ranges, and files are folded by
``FAN_OUT`` up to the roots of a tree (one, or two where files have negative and
other numbers): files of pages by id, files of pages without id, and files of
an id that has more records than a file should hold.

The audit compares the roots and then, level by level, only the children of
nodes that differ, down to the records of differing ranges.

Everything is DataFrame expressions; record bytes never leave the scan.  A file
holds about ``FILE_PAGES`` records, whatever the number of rows of an id.

Defined results
---------------
* null url or html: an empty string in the record.
* repeated pages (same id, url and html): one record, as a crawl's index has.
* null ``page_id``: filed in files of their own, by payload.
* equal replicas: no rows.  Empty replicas: no rows.
* very long pages: hashed within the scan.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cladeframe.llm.tables import discard, materialize, maybe_broadcast

FILE_PAGES = 256
RANGES = 16
FAN_OUT = 16
FILE = ["tree", "number"]


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def record_parts(page_id: Column, url: Column, html: Column) -> tuple[Column, Column, Column]:
    """(id, head, body) of a WARC response record; its bytes are head, body and two line ends."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    name = F.concat(F.coalesce(page_id.cast("string"), F.lit("null")), F.lit("-"), sha(F.concat(url, F.lit("\n"), body)))
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), name, F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return name, head, body


def damage(record: Column, digest: Column, body_at: Column) -> Column:
    """The record's bytes in a replica with faults, drawn by the first byte of its digest; null: lost.

    Of 256 values, 00 to 0f get another first byte of the body, 10 to 17 lose
    their record, 18 to 1f its last third; all else is as it was.
    """
    head = F.substring(digest, 1, 2)
    x, y = F.unhex(F.lit("58")), F.unhex(F.lit("59"))
    flipped = F.overlay(record, F.when(F.substr(record, body_at, F.lit(1)) == x, y).otherwise(x), body_at, F.lit(1))
    n = F.octet_length(record)
    cut = F.substr(record, F.lit(1), n - F.floor(n / 3).cast("int"))
    return F.when(head <= "0f", flipped).when(head <= "17", F.lit(None).cast("binary")).when(head <= "1f", cut).otherwise(record)


def records(pages: DataFrame) -> DataFrame:
    """record_id, page_id, tree, number, leaf, and length and digest in two replicas (``_a``; ``_b`` damaged) of every record."""
    name, head, body = record_parts(F.col("page_id"), F.col("url"), F.col("html"))
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), name.alias("record_id"), head.alias("head"), body.alias("body"))
    raw = raw.select("page_id", "record_id", F.octet_length("head").alias("at"), F.concat("head", "body", F.lit("\r\n\r\n")).cast("binary").alias("record"))
    raw = raw.withColumn("digest_a", F.sha2("record", 256))
    raw = raw.withColumn("other", damage(F.col("record"), F.col("digest_a"), F.col("at") + 1))
    known = raw.select(
        "page_id", "record_id", F.octet_length("record").cast("long").alias("length_a"), "digest_a",
        F.octet_length("other").cast("long").alias("length_b"), F.sha2("other", 256).alias("digest_b"),
    )
    once = known.groupBy(*known.columns).agg(F.lit(1).alias("_")).drop("_")
    once = materialize(once.withColumn("group", F.floor(F.col("page_id") / FILE_PAGES)), "warc-records")
    # groups with more records than two files should hold, and the pages without id, are cut by payload
    sizes = once.groupBy("group").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") > 2 * FILE_PAGES) | F.col("group").isNull())
    large = materialize(sizes.select("group", F.ceil(F.col("n") / FILE_PAGES).alias("cuts")), "warc-large")
    n = large.count()
    placed = once.alias("r").join(maybe_broadcast(large, n).alias("g"), F.col("r.group").eqNullSafe(F.col("g.group")), "left").select("r.*", "g.cuts")
    payload = F.substring_index("record_id", "-", -1)
    number = lambda at, length: F.conv(F.substring(payload, at, length), 16, 10).cast("long")
    tree = F.when(F.col("group").isNull(), "null").when(F.col("cuts").isNotNull(), F.concat(F.lit("cut-"), F.col("group").cast("string"))).otherwise("crawl")
    by_id = F.floor(F.pmod("page_id", F.lit(FILE_PAGES)) * RANGES / FILE_PAGES)
    leaf = F.when(F.col("cuts").isNotNull(), number(9, 4) % RANGES).otherwise(by_id)
    return placed.select(
        "record_id", "page_id", tree.alias("tree"), F.coalesce(number(1, 8) % F.col("cuts"), "group").alias("number"), leaf.cast("int").alias("leaf"),
        "length_a", "digest_a", "length_b", "digest_b",
    )


def offsets(known: DataFrame, side: str) -> DataFrame:
    """The index of a replica: tree, number (of the file), leaf, record_id, page_id, offset, length, digest."""
    here = known.filter(F.col(f"digest_{side}").isNotNull()).select("record_id", "page_id", *FILE, "leaf", F.col(f"length_{side}").alias("length"), F.col(f"digest_{side}").alias("digest"))
    ahead = Window.partitionBy(*FILE).orderBy("leaf", F.col("page_id").asc_nulls_first(), "record_id").rowsBetween(Window.unboundedPreceding, -1)  # the records of a file
    return here.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))


def lay_out(pages: DataFrame) -> DataFrame:
    """The index of the files that hold the pages."""
    return offsets(records(pages), "a")


def _fold(rows: DataFrame, keys: list[str], place: Column) -> DataFrame:
    """(keys, hash): SHA-256 over (place, hash) of the rows of a key, in order."""
    below = F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("hash"))))
    return rows.groupBy(*keys).agg(sha(F.array_join(F.transform(below, lambda x: F.concat_ws(":", x["p"].cast("string"), x["hash"])), ",")).alias("hash"))


def trees(index: DataFrame) -> list[DataFrame]:
    """The levels of the trees: ranges (tree, number, leaf), files, and files folded by FAN_OUT (tree, number) up to a root a tree."""
    start = F.min("offset").over(Window.partitionBy(*FILE, "leaf"))
    held = index.withColumn("rel", F.col("offset") - start).withColumn("hash", F.concat_ws(":", F.col("length").cast("string"), "digest"))
    out = [materialize(_fold(held, [*FILE, "leaf"], F.col("rel")), "warc-ranges")]
    out.append(materialize(_fold(out[0], FILE, F.col("leaf")), "warc-files"))
    ends = out[1].agg(F.min("number").alias("a"), F.max("number").alias("b")).first()
    low, high = ends["a"] or 0, ends["b"] or 0
    while low != high and (low, high) != (-1, 0):  # halving leads to -1 and 0 and not beyond
        low, high = low // FAN_OUT, high // FAN_OUT
        up = out[-1].withColumnRenamed("number", "place").withColumn("number", F.floor(F.col("place") / FAN_OUT))
        out.append(materialize(_fold(up, FILE, F.col("place")), "warc-nodes"))
    return out


def differing(a: list[DataFrame], b: list[DataFrame]) -> DataFrame:
    """(tree, number, leaf) of the ranges that differ, found from the roots down; the descent starts at the highest level that both replicas have."""
    parents = None
    for level in range(min(len(a), len(b)) - 1, -1, -1):
        key = [*FILE, "leaf"] if level == 0 else FILE
        here = []
        for side in (a[level], b[level]):
            if parents is not None:
                up = F.col("number") if level == 0 else F.floor(F.col("number") / FAN_OUT)
                side = side.withColumn("up", up).join(parents.select("tree", F.col("number").alias("up")), ["tree", "up"], "left_semi")
            here.append(side)
        x, y = (n.select(*key, F.col("hash").alias(f"hash_{s}")) for n, s in zip(here, "ab"))
        parents = x.join(y, key, "full").filter(~F.col("hash_a").eqNullSafe(F.col("hash_b"))).select(*key)
    return parents


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for each record that differs: ids, file, range, status, offsets (-1 where it is not) and digests in both replicas.

    status: ``corrupt`` (other bytes), ``missing`` (only in a), ``extra`` (only in b).
    """
    up_a, up_b = trees(a), trees(b)
    bad = materialize(differing(up_a, up_b), "warc-bad")
    discard(*up_a, *up_b)
    own = ["record_id", *FILE, "leaf"]
    sides = [
        index.join(bad, [*FILE, "leaf"], "left_semi").select(*own, *(F.col(c).alias(f"{c}_{s}") for c in ("page_id", "offset", "length", "digest")))
        for s, index in (("a", a), ("b", b))
    ]
    both = sides[0].join(sides[1], own, "full")
    status = F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra").otherwise("corrupt")
    differs = ~(F.col("digest_a").eqNullSafe(F.col("digest_b")) & F.col("length_a").eqNullSafe(F.col("length_b")))
    return both.filter(differs).select(
        F.coalesce("page_id_a", "page_id_b").alias("page_id"), "record_id", F.concat_ws("-", "tree", F.col("number").cast("string")).alias("file"), "leaf",
        status.alias("status"), *(F.coalesce(f"offset_{s}", F.lit(-1).cast("long")).alias(f"offset_{s}") for s in "ab"), "digest_a", "digest_b",
    )


def audit_damaged(pages: DataFrame) -> DataFrame:
    """The audit of the pages' files against a replica whose bytes :func:`damage` has changed."""
    known = records(pages)
    a, b = (materialize(offsets(known, side), f"warc-index-{side}") for side in "ab")
    return audit(a, b)

"""A corpus pipeline: language, near copies, personal data, mixing, tokens.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's documents.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeframe.llm import bpe_transducer, jaccard_join, langid_bloom, pii_crf, source_mixing
from cladeframe.llm.tables import discard, load, materialize, maybe_broadcast

#: Documents whose best language explains less of them are rejected.
MIN_LANGUAGE_SCORE = 0.25


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: ``und``, or a score below MIN_LANGUAGE_SCORE.

    A null or empty text has none.  Every row is decided by its own text, so
    repeated rows and null ids stay or go with it; no rows give no rows.
    """
    model = langid_bloom.fit(docs)
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("text"))  # names of extra columns cannot clash
    found = langid_bloom.predict(whole, model, ["_doc"])
    return found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("_doc.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component: the one with the smallest id, of a null id only if there is no other.

    An id that one row has decides for it; rows of a repeated or a null id are
    decided by (id, class of the text).  Rows without words are copies of none
    but rows of their id with the same text.
    """
    rows, labels = jaccard_join.labelled_classes(docs)
    n = labels.count()
    kept = (F.col("cls") == F.col("first_cls")) & F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = rows.join(maybe_broadcast(labels, n), "cls").filter(~kept & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    again = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1 or doc_id is null").select("doc_id")
    again = materialize(again, "pipeline-repeated")
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    single = docs.filter("doc_id is not null").join(again, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)
    several = docs.filter("doc_id is null").select(*docs.columns).unionByName(docs.join(again, "doc_id", "left_semi").select(*docs.columns))
    wrapped = several.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("text"))  # names of extra columns cannot clash
    classed = jaccard_join.with_class(wrapped, "_doc").withColumn("doc_id", F.col("_doc.doc_id")).join(maybe_broadcast(labels, n), "cls", "left")
    classed = materialize(classed, "pipeline-classed")
    alone = classed.filter("first_cls is null and (cls <> 0 or doc_id is null)").select("_doc.*")
    blank = classed.filter("cls = 0 and doc_id is not null").select("_doc.*").dropDuplicates(["doc_id", "text"])
    first = classed.filter(kept).groupBy("first_cls").agg(F.min_by("_doc", F.col("_doc.text")).alias("_doc")).select("_doc.*")
    return single.unionByName(alone).unionByName(blank).unionByName(first)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every span found; no document goes.

    A null text stays null, an empty one empty; repeated rows and null ids stay
    as they are; no rows give no rows.
    """
    return pii_crf.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents of the clean domain and thins out the others to the target weights.

    The draw is a hash of id and text: repeated rows stay or go together, a
    null id draws by its text; no labels or no rows raise nothing.
    """
    return source_mixing.sample(docs, load(spark, sf_dir, "labels"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes and the packed ids of what is left: a row for each row, null ids and repeats included.

    A null text counts as empty: no tokens, the hashes of no bytes.
    """
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_transducer.encode_texts(docs, vocabulary, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("tokens", tokens),
]

#: The language model, the random field and the classifier are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(before)  # what an earlier stage wrote; the input itself is none of these
    return STAGES[-1][1](spark, docs, sf_dir)

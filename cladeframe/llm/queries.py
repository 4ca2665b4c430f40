"""The registered queries of the subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cladeframe.llm import (
    ann_projection,
    bpe_transducer,
    jaccard_join,
    langid_bloom,
    pii_crf,
    quality_llr,
    simhash_vptree,
    source_mixing,
    url_rules,
    warc_fixity,
    whitening,
    wordpiece_counts,
)
from cladeframe.llm.tables import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_llr.quality_filter(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.url_filter(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid_bloom.identify(load(spark, sf_dir, "documents"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_projection.nearest(load(spark, sf_dir, "embeddings"), every=100, k=10)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(load(spark, sf_dir, "documents"))


def op6_word_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = wordpiece_counts.sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    return wordpiece_counts.count_tokens(load(spark, sf_dir, "documents"), first, later)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_fixity.audit_damaged(load(spark, sf_dir, "pages"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find(load(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_transducer.encode_texts(load(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whiten(load(spark, sf_dir, "embeddings")))


def op12_simhash_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vptree.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash_vptree.hex_digits("bits").alias("fingerprint"), "component_id")


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_quality_llr, op2_url_rules, op3_language_id, op4_nearest_neighbours, op5_jaccard_join,
        op6_word_piece_counts, op7_source_mixing, op8_warc_fixity, op9_personal_data, op10_byte_bpe,
        op11_embedding_whitening, op12_simhash_near_copies,
    )}

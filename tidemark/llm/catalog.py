"""Queries of this subpackage: one per operator, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import alignment, centroids, decontam, langid, linechunks, pieces, private, quality, rankbpe, simhash, suffixes, tokenids, toxicity
from tidemark.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return deco


@register("op1_decontamination", decontam.ORACLE)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items: windows of 10 words."""
    return decontam.contamination_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels that are not held out."""
    return toxicity.toxicity_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op3_private_data")
def op3_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return private.private_report(read(spark, sf_dir, "documents"))


@register("op4_token_ids")
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as planes and read back."""
    return tokenids.ids_report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from rows that are not held out."""
    return langid.language_report(read(spark, sf_dir, "documents"))


@register("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the chunks of lines that occurred before."""
    return linechunks.chunks_report(read(spark, sf_dir, "documents"))


@register("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents, encoded and decoded."""
    return pieces.pieces_report(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@register("op8_quality_rules")
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned quality rules over all documents."""
    return quality.quality_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@register("op9_suffix_dedup")
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents without the strings of 400 bytes that occur again."""
    return suffixes.repeats_report(read(spark, sf_dir, "documents"))


@register("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates of all documents: 4-word shingles, 4 bits."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, max_bits=4)


@register("op11_rank_bpe")
def op11_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by a local rank file, and the bytes they spell."""
    return rankbpe.ranks_report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register("op12_centroids", centroids.ORACLE)
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters, three rounds."""
    return centroids.clusters_report(read(spark, sf_dir, "embeddings"))


@register("op13_alignment")
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of two tokenizers aligned on the bytes of all documents."""
    return alignment.alignment_report(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

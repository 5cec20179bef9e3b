"""Registered queries of this folder and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailtally.llm.classifier import quality_scores
from trailtally.llm.common import table
from trailtally.llm.embedding_dedup import embedding_links
from trailtally.llm.html_extract import page_texts
from trailtally.llm.line_dedup import LINE_DEDUP_SQL, line_digests
from trailtally.llm.lm_scoring import document_scores
from trailtally.llm.near_dedup import near_duplicate_classes
from trailtally.llm.nearest import NEAREST_SQL, nearest_vectors
from trailtally.llm.packing import pack
from trailtally.llm.prefix_trie import PREFIX_TRIE_SQL, conversation_trie
from trailtally.llm.quality_rules import quality_verdicts
from trailtally.llm.sentencepiece_codec import document_pieces
from trailtally.llm.spelling import SPELLING_SQL, spelling_variants
from trailtally.llm.url_filter import URL_FILTER_SQL, url_verdicts

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(spark, folder)


def op2_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return document_pieces(spark, folder)


def op3_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_verdicts(spark, folder)


def op4_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return document_scores(spark, folder)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(spark, folder)


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return page_texts(spark, folder)


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_digests(table(spark, folder, "documents"))


def op9_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_links(spark, folder)


def op10_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_classes(spark, folder)


def op11_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_vectors(spark, folder)


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(spark, folder)


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(spark, folder)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_sentencepiece,
        op3_url_filter,
        op4_lm_scoring,
        op5_packing,
        op6_quality_rules,
        op7_html_extraction,
        op8_line_dedup,
        op9_embedding_dedup,
        op10_near_dedup,
        op11_nearest_neighbours,
        op12_spelling_variants,
        op13_prefix_trie,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": URL_FILTER_SQL,
    "op8_line_dedup": LINE_DEDUP_SQL,
    "op11_nearest_neighbours": NEAREST_SQL,
    "op12_spelling_variants": SPELLING_SQL,
    "op13_prefix_trie": PREFIX_TRIE_SQL,
}

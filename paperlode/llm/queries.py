"""Queries of the operators for language-model data."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from paperlode.llm import leaks, pii, scans, spam, splitting, tokens, vectors
from paperlode.tables import table

#: Folder of the public vocabularies.
TOKENIZERS = os.environ.get("PAPERLODE_TOKENIZERS", "/opt/tokenizers")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """What is repaired in the pages: broken and misread words, running headers and page numbers."""
    return scans.repairs(table(spark, d, "pages_in"), table(spark, d, "shard_results"))


def p2_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text as paragraphs."""
    return scans.paragraphs(table(spark, d, "pages_in"), table(spark, d, "shard_results"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal information in the texts of chunks and lines."""
    return pii.found(table(spark, d, "chunks"), table(spark, d, "doc_lines"))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The same texts with typed placeholders."""
    return pii.redacted(table(spark, d, "chunks"), table(spark, d, "doc_lines"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks over their limit."""
    return splitting.oversized(table(spark, d, "chunks")).select("chunk_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of the chunks over their limit."""
    return splitting.pieces(table(spark, d, "chunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors of which one is among the five most similar to the other."""
    return vectors.pairs(vectors.nearest(table(spark, d, "vector_store", "vec_id", "embedding"), k=5))


def p5_hits(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar vectors of every vector."""
    return vectors.nearest(table(spark, d, "vector_store", "vec_id", "embedding"), k=5)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return tokens.token_ids(table(spark, d, "documents", "doc_id", "text"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 13 consecutive words of a held-out item."""
    return p8_passages(spark, d).select("item_id", "doc_id").distinct()


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """The passages found, with their places."""
    return leaks.leaked(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "text"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents of which more than half is stuffed keywords, links or product tags."""
    return p9_scores(spark, d).where("stuffed_page").select("doc_id").distinct()


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """The shares measured for every document, with the verdict."""
    return spam.scored(table(spark, d, "documents", "doc_id", "text", "lang")).select("doc_id", "lang", *spam.FEATURES, "stuffed_page")


QUERIES = {f.__name__: f for f in (p2_found, p2_paragraphs, p3_found, p3_redacted, p4_found, p4_pieces, p5_found, p5_hits, p7_ids, p8_found, p8_passages, p9_found, p9_scores)}
ORACLES: dict[str, str] = {}

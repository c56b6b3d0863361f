"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.llm import (
    chat_format, embedding_dedup, exact_dedup, html_extraction, language_id, lexical_search, line_dedup, mixing,
    ngram_join, packing, secret_scan, token_alignment, token_counts,
)
from voxlake.llm.common import table
from voxlake.session import new_path, write_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY)


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract_pages(table(spark, sf_dir, "pages"))


@query
def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = chat_format.rotate_perspectives(table(spark, sf_dir, "conversations"))
    return views.withColumn("spans", chat_format.span_digest())


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents"))


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = token_alignment.align_tokens(table(spark, sf_dir, "documents"), VOCABULARY, PIECES, overlaps=False)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    kept = aligned.select(
        "doc_id", "n_a", "n_b", F.size("cuts").cast("long").alias("n_groups"),
        F.size("linked_a").cast("long").alias("n_links"), digest.alias("groups_sha256"), *token_alignment.LINKS,
    )
    return token_alignment.with_link_strength(write_table(kept, "aligned"))


@query
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cache of its own, empty at first: every distinct text is encoded once."""
    return token_counts.count_tokens(
        table(spark, sf_dir, "documents"), VOCABULARY, new_path(spark, "token-counts")
    ).drop("digest")


@query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

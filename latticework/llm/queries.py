"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from latticework.llm import bigru_langid, bin_completion, bpe_chunks, dom_trees, exact_dedup, line_dedup, pii_surrogates, prefix_trie, quality_eb, simhash_trie, token_alignment, url_reputation, vafile_topk
from latticework.llm.common import read


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_surrogates.surrogate_documents(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_eb.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return bpe_chunks.encode_documents(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile_topk.exact_top_k(read(spark, sf_dir, "embeddings"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.near_dedup(read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigru_langid.identify(read(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_reputation.filter_urls(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null roles and texts are empty, rows without conv_id are left out, an empty table has no node."""
    return prefix_trie.prefix_trie(read(spark, sf_dir, "conversations"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null html and pages without main text have an empty text, repeated rows stay, an empty table gives none."""
    return dom_trees.main_texts(read(spark, sf_dir, "pages"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null and empty texts have zeros, repeated rows count as documents of their own, an empty table gives none."""
    path = public_tokenizers.path
    return token_alignment.cross_alignment(read(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def queries() -> dict:
    return {f.__name__: f for f in (op1_pii_surrogates, op2_best_fit_packing, op3_quality_classifier, op4_bpe_chunks, op5_exact_topk, op6_simhash_dedup, op7_language_id, op8_url_filters, op9_exact_dedup, op10_line_dedup, op11_prefix_trie, op12_html_extraction, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_topk": vafile_topk.ORACLE_SQL, "op8_url_filters": url_reputation.ORACLE_SQL, "op9_exact_dedup": exact_dedup.ORACLE_SQL, "op11_prefix_trie": prefix_trie.ORACLE_SQL}

"""The registered queries of this subpackage, each an operator over its whole table, and their check SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from textprep.llm import byte_bpe, checks, decontaminate, hard_negatives, host_rules, language, main_text, near_dedup, passages, prefix_trie, quality, token_store, toxicity, vector_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {
    "op2_suffix_decontamination": checks.DECONTAMINATION,
    "op3_minhash_near_dedup": checks.NEAR_DUPLICATES,
    "op6_host_rules": checks.HOST_RULES,
    "op11_threshold_negatives": checks.HARD_NEGATIVES,
    "op12_tiled_vector_dedup": checks.VECTOR_DUPLICATES,
    "op13_rollup_trie": checks.PREFIX_TRIE,
}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _vocabulary(name: str) -> str:
    """A file of the public tokenizers: in the folder TOKENIZERS_DIR names, else where the package has it."""
    folder = os.environ.get("TOKENIZERS_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_vocabulary() -> tuple[str, str]:
    """(file of ranks, pattern) of the byte-level tokenizer."""
    import public_tokenizers

    return _vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@_query
def op1_neighbour_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(spark, _table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op2_suffix_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents, benchmark = _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    return decontaminate.contamination(spark, documents, benchmark).drop("found", "longest")


@_query
def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


@_query
def op4_sparse_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = passages.repeated_passages(_table(spark, folder, "documents"))
    return found.select("doc_id", "first_doc_id", "start_word", "n_words")


@_query
def op5_boosted_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_texts(spark, _table(spark, folder, "pages"))


@_query
def op6_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    found = host_rules.rule_verdicts(_table(spark, folder, "documents"))
    return found.withColumn("host_rate", F.round("host_rate", 6))


@_query
def op7_addressable_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.stored_documents(spark, _table(spark, folder, "documents"), _vocabulary("word_bpe_49k.json"))


@_query
def op8_convolution_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(spark, _table(spark, folder, "documents"), _table(spark, folder, "labels"))


@_query
def op9_bayes_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.predicted_languages(spark, _table(spark, folder, "documents"))


@_query
def op10_tree_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.token_digests(spark, _table(spark, folder, "documents"), *byte_vocabulary())


@_query
def op11_threshold_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, folder, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 50 == 0)


@_query
def op12_tiled_vector_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.vector_duplicates(_table(spark, folder, "embeddings"))


@_query
def op13_rollup_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns, convs = prefix_trie.numbered_turns(_table(spark, folder, "conversations"))
    head, shared = F.col("conv_id") - F.col("conv_id") % 100, F.crc32(F.col("conv_id").cast("string")) % 6
    return prefix_trie.prefix_trie(*prefix_trie.with_shared_heads(turns, convs, head, shared, most=5))

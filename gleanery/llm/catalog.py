"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm import bpe, collocations, conversation_trie, exact, hosts, minmax, packing, preferences, shards, simhash, suffixes, token_counts, warc
from gleanery.llm.common import table

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
MAX_TOKENS = 2048


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_counts.prefix_counts(table(spark, sf_dir, "documents"), WORDS)
    n = token_counts.n_tokens()
    return rows.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > MAX_TOKENS).alias("over_limit"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op4_min_max_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.near_groups(table(spark, sf_dir, "documents"))


def op5_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.extendible_shards(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), BYTES, public_tokenizers.PATTERN, digests=True)


def op7_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the masks as ``start-end`` texts."""
    pairs = preferences.preference_pairs(*preferences.neighbours(table(spark, sf_dir, "conversations")))

    def spans(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")

    return pairs.withColumns({"chosen_mask": spans("chosen_mask"), "rejected_mask": spans("rejected_mask")})


def op8_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.content_sort(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), WORDS)


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.quality_rules(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.rebuilt_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup, op2_token_counts, op3_warc, op4_min_max_groups, op5_extendible_shards, op6_byte_bpe, op7_preference_pairs,
        op8_content_sort, op9_best_fit_packing, op10_host_rules, op11_collocations, op12_conversation_trie, op13_simhash,
    )
}

"""Registered queries of the text operators: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import (
    attribution,
    decontamination,
    language,
    licenses,
    merkle,
    neardup,
    packing,
    prefix_trie,
    quality,
    radix,
    repeats,
    secrets,
    sharding,
)
from gridloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {
    "op6_byte_shards": sharding.SQL,
    "op10_license_templates": licenses.sql(),
    "op11_prefix_trie": prefix_trie.SQL,
    "op12_radix_duplicates": radix.SQL,
    "op13_merkle_manifest": merkle.SQL,
}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_line_tokens(spark, folder):
    import public_tokenizers

    return attribution.section_counts(
        table(spark, folder, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


@query
def op2_tiered_packing(spark, folder):
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer("word_bpe_49k.json"))


@query
def op3_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    model = language.fit_language(docs)
    said = docs.select(
        "doc_id", language.held_out("doc_id").alias("held_out"),
        language.predict_language("text", model).alias("said"),
    )
    return said.select("doc_id", "held_out", "said.*")


@query
def op4_seed_and_align(spark, folder):
    return decontamination.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


@query
def op5_suffix_repeats(spark, folder):
    return repeats.remove_repeats(table(spark, folder, "documents"))


@query
def op6_byte_shards(spark, folder):
    return sharding.byte_shards(table(spark, folder, "documents"))


@query
def op7_markov_secrets(spark, folder):
    docs = table(spark, folder, "documents")
    return secrets.secret_scan(docs, secrets.fit_models(docs))


@query
def op8_bag_minhash(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query
def op9_decision_list(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.quality_rules(docs, quality.learn_rules(docs, table(spark, folder, "labels")))


@query
def op10_license_templates(spark, folder):
    scanned = table(spark, folder, "documents").select(
        "doc_id", licenses.license_scan("text").alias("said")
    )
    return scanned.select("doc_id", "said.*")


@query
def op11_prefix_trie(spark, folder):
    return prefix_trie.conversation_trie(table(spark, folder, "conversations"))


@query
def op12_radix_duplicates(spark, folder):
    return radix.exact_duplicates(table(spark, folder, "documents"))


@query
def op13_merkle_manifest(spark, folder):
    return merkle.manifest(table(spark, folder, "documents"))

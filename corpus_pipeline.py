"""The corpus pipeline: five stages over ``documents``, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import decontamination, language, neardup, packing, queries, secrets
from gridloom.llm.common import free_name, table
from gridloom.session import scratch_path


TIMES_CHANCE = 1.5  # the best language must be so much likelier than a blind guess


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell.

    Texts that are NULL or without a letter go, and those whose best language has less than
    ``TIMES_CHANCE`` times the share of a blind guess (never more than a half) by the calibrated
    probabilities: the model cannot tell them from any other language.  Without a labelled row the
    model knows no language; all texts with a letter stay then.
    """
    model = language.fit_language(docs)
    if not model.languages:
        return docs.where(language.has_letter("text"))
    least = min(0.5, TIMES_CHANCE / len(model.languages))
    said = free_name(docs, "said_")
    judged = docs.withColumn(said, language.predict_language("text", model))
    return judged.where((F.col(said)["lang_pred"] != "und") & (F.col(said)["score"] >= least)).drop(said)


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every near-duplicate class, the one of least id."""
    return neardup.keep_one(docs)


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no test item."""
    return decontamination.clean_of(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in their text masked and ``n_chars`` counted anew."""
    masked = secrets.redacted(docs, secrets.fit_models(docs))
    return masked.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack_documents(docs, queries.tokenizer("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("minhash_near_dedup", keep_one_copy),
    ("benchmark_decontamination", keep_clean_of_benchmark),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]

# Learned models, signatures and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

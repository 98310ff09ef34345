"""Small helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def digest(text: str | Column) -> Column:
    """Identity of a whole text: its MD5, so that copies meet without shipping the text."""
    return F.md5(F.col(text) if isinstance(text, str) else text)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not use yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def once(udf):
    """Keep the optimiser from copying a costly function into inferred or pushed filters.

    Spark evaluates a deterministic Python function again wherever its result is tested.
    """
    return udf.asNondeterministic()


def clean(texts) -> list[str]:
    """A pandas column of texts as a list, NULL as the empty string."""
    return [t if isinstance(t, str) else "" for t in texts]

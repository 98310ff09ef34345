"""Choosing model checkpoints from their file names, and tracking written tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from gridloom.functions import text
from gridloom.operators.ranks import top_row


def parse_checkpoints(df: DataFrame, path: str = "path") -> DataFrame:
    p = F.col(path)
    return df.select(
        "*",
        text.checkpoint_epoch(p).alias("epoch"),
        text.checkpoint_metric(p).alias("metric"),
        text.checkpoint_version(p).alias("version"),
    )


def _choose(df: DataFrame, run: str, path: str, order: list[tuple[str, str]]) -> DataFrame:
    """A run whose names all fail to parse keeps a row with the path ``null``."""
    parsed = parse_checkpoints(df.select(run, path), path)
    ranked = parsed.withColumn("bad_", F.when(F.col("epoch").isNull(), 1).otherwise(0))
    best = top_row(ranked, [run], [("bad_", "asc"), *order, (path, "asc")])
    chosen = F.when(F.col("bad_") == 0, F.col(path)).otherwise(F.lit("null"))
    return best.withColumn(path, chosen).drop("bad_")


def best_checkpoint(df: DataFrame, run: str = "run_id", path: str = "path") -> DataFrame:
    """Smallest metric; ties go to the later epoch, then to the higher version."""
    return _choose(df, run, path, [("metric", "asc"), ("epoch", "desc"), ("version", "desc")])


def latest_checkpoint(df: DataFrame, run: str = "run_id", path: str = "path") -> DataFrame:
    """Latest epoch, then highest version."""
    return _choose(df, run, path, [("epoch", "desc"), ("version", "desc")])


def in_order(df: DataFrame, run: str = "run_id", path: str = "path") -> DataFrame:
    """Every checkpoint with its ``place`` in its run, the latest first.

    A run holds one file per saved epoch, which bounds the window; unreadable names come last.
    """
    latest = W.partitionBy(run).orderBy(
        F.col("epoch").desc_nulls_last(), F.col("version").desc(), F.col(path)
    )
    return parse_checkpoints(df, path).withColumn("place", F.row_number().over(latest).cast("long"))


def tile_progress(expected: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """How many expected tiles were written, and how many are missing."""
    marks = written.select(*keys).distinct().withColumn("done_", F.lit(1))
    return expected.select(*keys).join(marks, keys, "left").agg(
        F.count(F.lit(1)).alias("expected"),
        F.count("done_").alias("written"),
        F.count_if(F.col("done_").isNull()).alias("missing"),
    )


def missing_tiles(expected: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(written.select(*keys), keys, "left_anti")

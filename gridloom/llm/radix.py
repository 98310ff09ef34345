"""Exact duplicates by most-significant-digit radix partitioning of whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.llm.common import free_name
from gridloom.operators.ranks import lookup_join
from gridloom.session import cut, scratch_path

HEAD = 24  # bytes of the first digit
WIDTH, GROWTH, WIDEST = 512, 16, 1 << 22  # bytes of the second digit, then times GROWTH up to WIDEST


def _staged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows after the first digit, stored: ``row, doc_id, size, data, text_sha256``.

    A text counts as its length followed by its bytes, so no text is a prefix of another one and
    the length takes part in the first digit.  ``data`` is left only where the first digit is shared.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"),
    ).select("*", F.octet_length("data").alias("size"), F.substring("data", 1, HEAD).alias("digit"))
    crowds = rows.groupBy("size", "digit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # the crowds are the small side: texts are dealt out once, and not sorted
    placed = lookup_join(rows, crowds.hint("shuffle_hash"), ["size", "digit"])
    path = scratch_path(spark, "radix")
    placed.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "size",
        F.when(F.col("n").isNotNull(), F.col("data")).alias("data"),
        F.sha2("data", 256).alias("text_sha256"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def _split(moved: DataFrame) -> DataFrame:
    """One radix step: rows ``(row, doc_id, size, part)`` whose group and digit another row shares.

    A part is named by its least row; rows alone with their digit are singletons and leave.
    """
    key = ["part", "size", "digit"]
    shared = moved.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.min("row").alias("next")
    ).where("n > 1").drop("n")
    return lookup_join(moved, shared, key).where("next IS NOT NULL").select(
        "row", "doc_id", "size", F.col("next").alias("part")
    )


def _groups(staged: DataFrame) -> DataFrame:
    """``(row, doc_id, part)`` of every row whose whole text another row has too."""
    live = staged.where("data IS NOT NULL")
    start, width = 0, WIDTH
    digit = lambda: F.substring("data", start + 1, width).alias("digit")
    alive = cut(_split(live.select("row", "doc_id", "size", F.lit(0).cast("long").alias("part"), digit())))
    ended = alive.where(F.col("size") <= width)
    while True:
        start, width = start + width, min(width * GROWTH, WIDEST)
        alive = alive.where(F.col("size") > start)
        if alive.isEmpty():
            return ended.select("row", "doc_id", "part")
        alive = cut(_split(alive.join(live.where(F.col("size") > start).select("row", digit()), "row")))
        ended = ended.unionByName(alive.where(F.col("size") <= start + width))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are split by successive runs of bytes, 24, 512 and then 16 times as many each round, up to
    4 MB, until a group is one row or its texts have ended: a text of any length takes a handful of
    rounds, one of many MB one more for every 4 MB.  Only rows that still share their group go on, and
    only the bytes of the round are shuffled.  Two texts are equal if all their bytes met in the same
    groups; the digest is an output and decides nothing.  Counts combine on the map side and rows meet
    their group's count in a join that adaptive execution can split, so a group may hold any share.

    NULL counts as empty, and empty texts are equal.  Of equal texts the row with the largest id stays,
    one of them if rows repeat; a NULL id is less than any other (``keep_id`` is NULL only if
    all ids of the group are).  Other columns are ignored; empty input gives no rows.
    """
    staged = _staged(df, id_col, text_col)
    groups = _groups(staged)
    best = groups.groupBy("part").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    marked = cut(lookup_join(groups, best, ["part"]))
    winners = marked.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("part").agg(
        F.min("row").alias("winner"))
    said = lookup_join(marked, winners, ["part"]).select(
        "row", "keep_id", "group_size", (F.col("row") == F.col("winner")).alias("kept"))
    alone = F.col("group_size").isNull()
    return staged.select("row", "doc_id", "text_sha256").join(said, "row", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce("kept", F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with one left of each group of equal texts, by the rules above.

    Of rows equal in id and text any one stays, whatever its other columns.
    """
    sha, key = free_name(df, "sha_"), free_name(df, "key_")
    kept = exact_duplicates(df, id_col, text_col).where("kept").select(
        F.col("doc_id").alias(key), F.col("text_sha256").alias(sha))
    marked = df.withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    same = F.col(id_col).eqNullSafe(F.col(key))
    return marked.join(kept, sha).where(same).dropDuplicates([sha]).drop(sha, key)


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (g ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

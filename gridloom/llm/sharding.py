"""Contiguous shards of nearly equal bytes, from global prefix sums of sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from gridloom.session import cut

OVERHEAD = 16  # bytes that a row counts besides its text


def byte_shards(
    df: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut the rows, ordered by id, into ``shards`` contiguous runs of nearly equal bytes.

    The rows are range-partitioned without their texts; sizes are summed per partition, the
    per-partition totals give every partition its start, and a running sum inside each
    partition gives every row its global byte position.  A row goes to the shard in which its
    midpoint lies, so a shard is off the equal target by less than its two border rows.

    Law ``bytes``.  NULL ids come first, NULL text counts no bytes (checksum 0).  Rows with one
    id are ordered by checksum and size; rows equal in all three are interchangeable and are
    spread by their place in the input, so one id never has to fit a task.  Copies of a text are
    not kept together.  Empty input gives no rows; other columns are ignored.

    Returns id, ``size, text_crc32, law, shard, slot, grown_shard``.
    """
    slim = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text_col)), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("at_"),
    )
    order = ["doc_id", "text_crc32", "size", "at_"]
    placed = cut(
        slim.repartitionByRange(*order).withColumn("part_", F.spark_partition_id())
    )  # the partition numbers must not move
    totals = placed.groupBy("part_").agg(
        F.sum("size").alias("bytes_"), F.count(F.lit(1)).alias("rows_")
    )
    # one row per partition
    upto = W.orderBy("part_").rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = totals.select(
        "part_",
        (F.sum("bytes_").over(upto) - F.col("bytes_")).alias("before_"),
        (F.sum("rows_").over(upto) - F.col("rows_")).alias("rank_"),
        F.sum("bytes_").over(W.partitionBy()).alias("total_"),
    )
    inside = W.partitionBy("part_").orderBy(*order)
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    positioned = placed.join(F.broadcast(starts), "part_").select(
        "doc_id",
        "size",
        "text_crc32",
        (F.col("rank_") + F.row_number().over(inside) - 1).alias("rank_"),
        # twice the midpoint, to stay with whole numbers
        (2 * (F.col("before_") + F.sum("size").over(running)) - F.col("size")).alias("mid_"),
        "total_",
    )
    sharded = positioned.withColumn(
        "shard",
        F.expr(f"least({shards - 1}, (mid_ * {shards}) div (2 * total_))").cast("int"),
    )
    firsts = sharded.groupBy("shard").agg(F.min("rank_").alias("first_"))  # one row per shard
    return sharded.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("rank_") - F.col("first_")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# The checksum is folded over the bytes with the usual table of the reflected polynomial.
SQL = """
WITH RECURSIVE step(n, k, v) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT n, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END
  FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS t FROM step WHERE k = 8),
sums AS (
  SELECT crc_key, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), bytes),
           lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS INT) + 1]))) AS crc
  FROM (SELECT crc_key,
               list_transform(regexp_extract_all(digits, '..'),
                 lambda h: CAST(concat('0x', h) AS BIGINT)) AS bytes
        FROM (SELECT DISTINCT text AS crc_key, hex(encode(text)) AS digits
              FROM documents WHERE text IS NOT NULL)), tab),
sized AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) + 16 AS BIGINT) AS size,
         CAST(coalesce(crc, 0) AS BIGINT) AS text_crc32
  FROM documents LEFT JOIN sums ON text = crc_key),
placed AS (
  SELECT *, sum(size) OVER w AS upto, sum(size) OVER () AS total, row_number() OVER w AS rn
  FROM sized
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
cuts AS (
  SELECT *, CAST(least(39, ((2 * upto - size) * 40) // (2 * total)) AS INT) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
       CAST(rn - min(rn) OVER (PARTITION BY shard) AS BIGINT) AS slot,
       CAST(NULL AS INT) AS grown_shard
FROM cuts
"""

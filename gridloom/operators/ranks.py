"""Exact order statistics that never gather an unbounded group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.functions.text import draw


def top_row(df: DataFrame, keys: list[str], order: list[tuple[str, str]]) -> DataFrame:
    """First row of every group in the given order.

    ``min_by`` combines on the map side, so a group of any size crosses the shuffle as
    one row per map task; a ranking window would sort the whole group in one task.
    Descending columns must be numeric; a NULL sorts last in either direction.
    """
    rest = [c for c in df.columns if c not in keys]
    terms: list[Column] = []
    for name, direction in order:
        terms.append(F.col(name).isNull())
        terms.append(-F.col(name) if direction == "desc" else F.col(name))
    key = F.struct(*[t.alias(f"k{i}") for i, t in enumerate(terms)])
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), key).alias("best_"))
    return best.select(*keys, "best_.*")


def exact_median(
    df: DataFrame, keys: list[str], values: list[str], n_col: str | None = None, spread: bool = False
) -> DataFrame:
    """Exact median of several columns per group.

    The rows are shuffled once, as they are, and the built-in median runs over the group; its partial
    form would ship a value map per group and cannot shrink distinct values.  A group must fit
    a task: a pixel's observations do.  ``spread=True`` is for tables whose groups do not: equal
    values are counted on the map side and every group is searched bucket by bucket, whatever its
    size, for the same result.  Key columns must not be NULL.
    """
    if spread:
        medians = _median_by_buckets(df, keys, values)
        if n_col:
            medians = medians.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n_col)), keys)
        return medians
    group = W.partitionBy(*keys)
    over = {v: F.median(v).over(group) for v in values}
    if n_col:
        over[n_col] = F.count(F.lit(1)).over(group)
    rows = df.select(*keys, *[c.alias(name) for name, c in over.items()])
    return rows.groupBy(*keys).agg(*[F.first(name).alias(name) for name in over])


def _median_by_buckets(
    df: DataFrame, keys: list[str], values: list[str], buckets: int = 4096
) -> DataFrame:
    """Median of huge groups: count equal values, cut each group's range into buckets, find the middle.

    One count per (group, bucket) tells which bucket holds the middle, and only that bucket is
    ranked.  The bucket of a value follows from the value and its group's range alone.
    """
    long = df.select(*keys, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(
        keys, values, "band_", "value_"
    )
    group = [*keys, "band_"]
    counted = long.where(F.col("value_").isNotNull()).groupBy(*group, "value_").agg(
        F.count(F.lit(1)).alias("c_")
    )
    spans = counted.groupBy(*group).agg(
        F.min("value_").alias("lo_"), F.max("value_").alias("hi_"), F.sum("c_").alias("n_")
    )
    width = F.col("hi_") - F.col("lo_")
    at = F.least(F.floor((F.col("value_") - F.col("lo_")) / width * buckets), F.lit(buckets - 1))
    placed = lookup_join(counted, spans, group).withColumn(
        "part_", F.when((width > 0) & (width < 1e308), at).otherwise(F.lit(0)).cast("int")
    )
    parts = placed.groupBy(*group, "part_", "n_").agg(F.sum("c_").alias("in_part_"))
    by_part = W.partitionBy(*group).orderBy("part_")
    offsets = parts.select(
        *group,
        "part_",
        "n_",
        (F.sum("in_part_").over(by_part) - F.col("in_part_")).alias("before_"),
        F.sum("in_part_").over(by_part).alias("upto_"),
    )
    low, high = F.floor((F.col("n_") + 1) / 2), F.floor(F.col("n_") / 2) + 1
    middle = offsets.where((F.col("before_") < high) & (F.col("upto_") >= low)).drop("n_")
    within = W.partitionBy(*group, "part_").orderBy("value_").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    ranked = placed.join(middle, [*group, "part_"]).withColumn(
        "last_", F.col("before_") + F.sum("c_").over(within)
    )
    first = F.col("last_") - F.col("c_") + 1

    def position(k: Column) -> Column:
        return F.max(F.when((first <= k) & (F.col("last_") >= k), F.col("value_")))

    medians = ranked.groupBy(*group).agg(((position(low) + position(high)) / 2).alias("median_"))
    wide = medians.groupBy(*keys).pivot("band_", values).agg(F.first("median_"))
    present = df.select(*keys).distinct()
    return present.join(wide, keys, "left")


def lookup_join(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of many rows with a table that has one row per key.

    A table that comes out of an aggregation is already dealt by its keys, and adaptive
    execution splits a crowded key only where both sides are dealt for the join itself.  A digest
    of the keys as one more join column brings that about, so a key may hold any share of the
    rows.
    """
    digest = F.xxhash64(*keys)
    return rows.withColumn("deal_", digest).join(
        table.withColumn("deal_", digest), ["deal_", *keys], "left"
    ).drop("deal_")


def _bucketed(df: DataFrame, keys: list[str], seed: int, epoch: int, digits: int) -> DataFrame:
    digest = draw([F.col(k) for k in keys], seed, epoch)
    return df.withColumn("digest_", digest).withColumn("bucket_", F.substring("digest_", 1, digits))


def _bucket_offsets(bucketed: DataFrame) -> DataFrame:
    """Rows before each bucket; one row for each of them, whatever the table's size."""
    sizes = bucketed.groupBy("bucket_").agg(F.count(F.lit(1)).alias("size_"))
    running = W.orderBy("bucket_").rowsBetween(W.unboundedPreceding, W.currentRow)
    return sizes.withColumn("start_", F.sum("size_").over(running) - F.col("size_")).withColumn(
        "total_", F.sum("size_").over(W.partitionBy())
    )


def hash_rank(
    df: DataFrame, keys: list[str], seed: int, epoch: int = 0, rank_col: str = "rank",
    digits: int = 4,
) -> DataFrame:
    """Zero-based position of every row in a reproducible random order.

    ``keys`` must identify a row.  Leading digits of the digest split the order into equal
    buckets, which are ranked side by side and shifted by the rows before them.
    """
    bucketed = _bucketed(df, keys, seed, epoch, digits)
    offsets = _bucket_offsets(bucketed).select("bucket_", "start_")
    inside = W.partitionBy("bucket_").orderBy("digest_", *keys)
    return (
        bucketed.join(F.broadcast(offsets), "bucket_")  # bounded by 16 ** digits rows
        .withColumn(rank_col, F.col("start_") + F.row_number().over(inside) - 1)
        .drop("digest_", "bucket_", "start_")
    )


def hash_sample(
    df: DataFrame, keys: list[str], ratio: float, seed: int, epoch: int = 0, digits: int = 4
) -> DataFrame:
    """Exactly ``floor(n * ratio)`` rows without replacement, redrawn for every epoch.

    Whole buckets below the cut pass without a shuffle; only the bucket holding the cut
    is ranked.  ``keys`` must identify a row.
    """
    bucketed = _bucketed(df, keys, seed, epoch, digits)
    offsets = _bucket_offsets(bucketed).withColumn("keep_", F.floor(F.col("total_") * F.lit(ratio)))
    marked = bucketed.join(F.broadcast(offsets), "bucket_").where(F.col("start_") < F.col("keep_"))
    inside_cut = F.col("start_") + F.col("size_") <= F.col("keep_")
    inside = W.partitionBy("bucket_").orderBy("digest_", *keys)
    edge = (
        marked.where(~inside_cut)
        .withColumn("rn_", F.row_number().over(inside))
        .where(F.col("start_") + F.col("rn_") <= F.col("keep_"))
        .drop("rn_")
    )
    return (
        marked.where(inside_cut)
        .unionByName(edge)
        .drop("digest_", "bucket_", "start_", "size_", "total_", "keep_")
    )


def dimension(df: DataFrame, column: str, index_col: str, buckets: int = 256) -> DataFrame:
    """Sorted distinct values of a dimension column with their zero-based position.

    Distinct values are merged on the map side.  Those of least hash, ``buckets - 1`` of them, cut the
    order into buckets that are ranked side by side and shifted by the values before them.  A value's
    bucket follows from the set of values alone, so a task that runs again puts it in the same place.
    NULL has no position.
    """
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    few = distinct.orderBy(F.xxhash64(column), column).limit(buckets - 1)  # bounded by ``buckets``
    cuts = few.agg(F.sort_array(F.collect_list(column)).alias("cuts_")).scalar()
    below = F.filter("cuts_", lambda c: c <= F.col(column))
    placed = distinct.withColumn("cuts_", cuts).select(column, F.size(below).alias("bucket_"))
    offsets = _bucket_offsets(placed).select("bucket_", "start_")
    inside = W.partitionBy("bucket_").orderBy(column)
    return (
        placed.join(F.broadcast(offsets), "bucket_")  # at most ``buckets`` rows
        .withColumn(index_col, (F.col("start_") + F.row_number().over(inside) - 1).cast("int"))
        .select(column, index_col)
    )

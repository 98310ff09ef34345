"""Cutting rasters into windows and folding windows back into one raster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def patchify(df: DataFrame, k: int) -> DataFrame:
    """Non-overlapping ``k x k`` windows: a projection, no shuffle."""
    return df.select(
        "*",
        F.floor(F.col("yi") / k).cast("int").alias("pr"),
        F.floor(F.col("xi") / k).cast("int").alias("pc"),
        F.pmod(F.col("yi"), F.lit(k)).cast("int").alias("oy"),
        F.pmod(F.col("xi"), F.lit(k)).cast("int").alias("ox"),
    )


def _covering(index: Column, size: Column, k: int, s: int) -> Column:
    """Windows of stride ``s`` that hold a pixel."""
    n = F.floor((size - k) / s) + 1
    lo = F.greatest(F.lit(0), F.ceil((index - k + 1) / s)).cast("int")
    hi = F.least(n - 1, F.floor(index / s)).cast("int")
    return F.explode(F.when(lo <= hi, F.sequence(lo, hi)))


def overlapping_patchify(
    df: DataFrame, height: int | Column, width: int | Column, k: int, stride: int
) -> DataFrame:
    """Overlapping ``k x k`` windows; each pixel is copied into every window that holds it."""
    h = F.lit(height) if isinstance(height, int) else height
    w = F.lit(width) if isinstance(width, int) else width
    return (
        df.withColumn("pr", _covering(F.col("yi"), h, k, stride))
        .withColumn("pc", _covering(F.col("xi"), w, k, stride))
        .withColumn("oy", (F.col("yi") - F.col("pr") * stride).cast("int"))
        .withColumn("ox", (F.col("xi") - F.col("pc") * stride).cast("int"))
    )


def fold(
    patches: DataFrame, keys: list[str], values: list[str], stride: int, count_col: str | None = None
) -> DataFrame:
    """Mosaic windows back to pixels: the mean where they overlap, the value where they do not."""
    placed = patches.withColumn("yi", (F.col("pr") * stride + F.col("oy")).cast("int")).withColumn(
        "xi", (F.col("pc") * stride + F.col("ox")).cast("int")
    )
    return overlap_mean(placed, [*keys, "yi", "xi"], values, count_col)


def overlap_mean(
    placed: DataFrame, cell: list[str], values: list[str], count_col: str | None = None
) -> DataFrame:
    """Mean of all contributions to a cell, in any order, each (cell) counted on its own."""
    aggs = [F.avg(v).alias(v) for v in values]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    return placed.groupBy(*cell).agg(*aggs)


def last_write(
    placed: DataFrame, cell: list[str], values: list[str], order: list[str]
) -> DataFrame:
    """The value written last to each cell."""
    latest = F.max_by(F.struct(*values), F.struct(*order)).alias("last_")
    return placed.groupBy(*cell).agg(latest).select(*cell, "last_.*")


def sum_pool(
    df: DataFrame, keys: list[str], value: str, k: int, out: str, minimum: float = 0.0
) -> DataFrame:
    """Sum over ``k x k`` patches; only patches above ``minimum`` remain."""
    pooled = patchify(df, k).groupBy(*keys, "pr", "pc").agg(F.sum(value).alias(out))
    return pooled.where(F.col(out) > minimum)


def patch_means(
    df: DataFrame, keys: list[str], value: str, k: int, time: str, steps: dict[int, str]
) -> DataFrame:
    """Mean per patch at chosen time steps, one column each.

    One missing pixel voids the patch, and a patch with a void step is dropped.
    """
    strict = F.when(F.count(F.lit(1)) == F.count(value), F.avg(value))
    wide = (
        patchify(df, k)
        .where(F.col(time).isin(list(steps)))
        .groupBy(*keys, "pr", "pc")
        .pivot(time, list(steps))
        .agg(strict)
    )
    for step, name in steps.items():
        wide = wide.withColumnRenamed(str(step), name)
    return wide.dropna(subset=list(steps.values()))


def flatten_pixels(
    df: DataFrame, keys: list[str], bands: list[str], time: str, steps: int
) -> DataFrame:
    """One feature vector per pixel: band-major, time within band; absent steps are NULL."""
    slots = F.sequence(F.lit(0), F.lit(steps - 1))
    grouped = df.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(time), F.struct(*bands)))).alias("by_t_")
    )
    def series(band: str) -> Column:
        return F.transform(slots, lambda t: F.try_element_at(F.col("by_t_"), t)[band])

    return grouped.select(*keys, F.concat(*[series(b) for b in bands]).alias("features"))


def unpack_fields(df: DataFrame, fields: str, n_bands: int) -> DataFrame:
    """Flat field list to ``(t, band, value)``: time-major, band-minor."""
    rest = [c for c in df.columns if c != fields]
    return df.select(*rest, F.posexplode(fields).alias("pos_", "value")).select(
        *rest,
        F.floor(F.col("pos_") / n_bands).cast("int").alias("t"),
        F.pmod(F.col("pos_"), F.lit(n_bands)).cast("int").alias("band"),
        "value",
    )

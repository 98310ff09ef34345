"""Tiles with a halo: neighbourhood operators with one shuffle and bounded groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def with_halo(df: DataFrame, keys: list[str], tile: int, halo: int) -> DataFrame:
    """Copy border pixels into neighbouring tiles and place each tile in one task.

    Adds ``ty_, tx_`` (tile position) and ``own_`` (the pixel belongs to this tile).  A tile
    holds at most ``(tile + 2 * halo) ** 2`` pixels per key, whatever the image size, and
    windows over ``(*keys, ty_, tx_, yi)`` or ``(..., xi)`` need no further shuffle.
    """
    def tiles(index: Column) -> Column:
        lo = F.floor((index - halo) / tile).cast("int")
        hi = F.floor((index + halo) / tile).cast("int")
        return F.explode(F.sequence(lo, hi))

    home_y = F.floor(F.col("yi") / tile)
    home_x = F.floor(F.col("xi") / tile)
    return (
        df.withColumn("ty_", tiles(F.col("yi")))
        .withColumn("tx_", tiles(F.col("xi")))
        .withColumn("own_", (F.col("ty_") == home_y) & (F.col("tx_") == home_x))
        .repartition(*keys, "ty_", "tx_")
    )


def row_window(keys: list[str], before: int, after: int):
    """Pixels from ``xi - before`` to ``xi + after`` on the same row of a tile."""
    return (
        W.partitionBy(*keys, "ty_", "tx_", "yi").orderBy("xi").rangeBetween(-before, after)
    )


def column_window(keys: list[str], before: int, after: int):
    """Pixels from ``yi - before`` to ``yi + after`` in the same column of a tile."""
    return (
        W.partitionBy(*keys, "ty_", "tx_", "xi").orderBy("yi").rangeBetween(-before, after)
    )


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(F.col("own_")).drop("ty_", "tx_", "own_")


def circle_spans(radius: float) -> dict[int, int]:
    """Half-width of a filled circle on each row offset: ``dx**2 + dy**2 <= radius**2``."""
    reach = int(radius)
    spans = {}
    for dy in range(-reach, reach + 1):
        width = 0
        while (width + 1) ** 2 + dy**2 <= radius**2:
            width += 1
        spans[dy] = width
    return spans


def focal(df: DataFrame, keys: list[str], value: str, radius: float, how: str, out: str) -> DataFrame:
    """Minimum or maximum over a circular neighbourhood inside a tile.

    The circle is a stack of row spans: one pass along rows per distinct span, then one
    pass down the columns.  The raster must be dense; NULL values are passed over.
    """
    agg, pick = (F.min, F.least) if how == "min" else (F.max, F.greatest)
    spans = circle_spans(radius)
    for width in sorted(set(spans.values())):
        df = df.withColumn(f"span{width}_", agg(value).over(row_window(keys, width, width)))
    parts = [
        agg(f"span{width}_").over(column_window(keys, -dy, dy)) for dy, width in spans.items()
    ]
    best = pick(*parts) if len(parts) > 1 else parts[0]
    return df.withColumn(out, best).drop(*[f"span{w}_" for w in set(spans.values())])

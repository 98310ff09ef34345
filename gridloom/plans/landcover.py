"""The jobs a land-cover study runs, each as one Spark plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.indices import ndvi
from gridloom.operators import grid, models, patches, polygons, stats
from gridloom.operators.composites import median_composite, medoid_composite
from gridloom.operators.masks import clear_pixels
from gridloom.sources.cubes import as_float, tile_of, tiles_per_folder, write_tiles

BANDS = ["b1", "b2", "b3", "b4", "b5", "b6"]


def index_by_label(
    observations: DataFrame, features: DataFrame, minx: float, maxy: float, scale: float
) -> DataFrame:
    """Mean NDVI of clear annual composites under the polygons of each (label, year).

    Observations shrink to composites before they meet the polygons, and polygons to
    distinct pixels per (label, year), so both sides of the join are as small as they get.
    """
    annual = median_composite(clear_pixels(observations), ["yi", "xi", "yr"], ["b3", "b4"])
    burned = polygons.burned_pixels(features, minx, maxy, scale, ["label", "yr"])
    joined = burned.join(annual, ["yi", "xi", "yr"])
    return joined.groupBy("label", "yr").agg(
        F.avg(ndvi(F.col("b4"), F.col("b3"))).alias("mean_ndvi"),
        F.count(F.lit(1)).alias("pixels"),
    )


def composite_tiles(
    observations: DataFrame, path: str, bands: list[str], composite: str = "median",
    tie_break: list[str] | None = None, tile: int = 256, across: int = 1 << 15,
) -> None:
    """Scenes to a stored cube: QA mask, annual composite, tiles keyed by place and year.

    Running it again for some years replaces the tiles of those years only.
    """
    clear = clear_pixels(observations)
    keys = ["yi", "xi", "yr"]
    if composite == "medoid":
        annual = medoid_composite(clear, keys, bands, tie_break or bands)
    else:
        annual = median_composite(clear, keys, bands)
    tiled = annual.withColumn("tile_id", tile_of(F.col("yi"), F.col("xi"), tile, tile, across))
    rows = as_float(tiled, bands).select("tile_id", "yr", "yi", "xi", *bands)
    write_tiles(rows, path, ("tile_id", "yr"), tiles=tiles_per_folder(tile * tile))


def statistics_documents(
    cube: DataFrame, features: DataFrame, extent: DataFrame, chunk: int, scale: float,
    bands: list[str], label: str, area: Column,
) -> dict[str, DataFrame]:
    """The two statistics tables a model reads: per band and per class."""
    return {
        "bands": layer_statistics(cube, features, extent, chunk, scale, bands),
        "classes": stats.class_stats(features, label, area),
    }


def annotate(
    features: DataFrame, extent: DataFrame, minx: float, maxy: float, chunk: int, scale: float,
    label: str, date: str,
) -> DataFrame:
    """Polygons to a label cube over the chunks they meet."""
    g = chunk * scale
    chunks = grid.chunk_grid(extent, g, g)
    kept = polygons.filter_chunks(chunks, features, extent, g, g)
    pixels = grid.chunk_pixels(kept.select("chunk_id", "r", "c"), chunk, chunk).drop("r", "c")
    return polygons.label_cube(pixels, features, minx, maxy, scale, label, date)


def layer_statistics(
    cube: DataFrame, features: DataFrame, extent: DataFrame, chunk: int, scale: float,
    bands: list[str],
) -> DataFrame:
    """Sample statistics of the pixels in chunks that meet a polygon, each pixel once."""
    g = chunk * scale
    kept = polygons.filter_chunks(grid.chunk_grid(extent, g, g), features, extent, g, g)
    inside = cube.withColumn("r", F.floor(F.col("yi") / chunk).cast("int")).withColumn(
        "c", F.floor(F.col("xi") / chunk).cast("int")
    )
    return stats.band_stats(inside.join(kept, ["r", "c"], "left_semi"), bands, ddof=1)


def score_and_mosaic(
    windows: DataFrame,
    cube: DataFrame,
    bands: list[str],
    size: int,
    scale: float,
    minx: Column,
    maxy: Column,
    load: Callable,
    activation: Callable[[Column], Column],
) -> DataFrame:
    """Padded windows, a user model, activation, un-padding, and the mean where windows overlap.

    ``windows`` come from :func:`grid.window_pads` and name their time step ``t``.
    """
    meta = ["sample_id", "t", "tx", "tY", "pad_top", "pad_bottom", "pad_left", "pad_right"]
    blocks = grid.padded_windows(windows, cube, size, size, {b: -1.0 for b in bands})
    packed = models.pack_blocks(blocks, meta, bands, ["oy", "ox"])
    scored = models.score_blocks(packed, meta, bands, (size, size), load, 1)
    cells = models.unpack_blocks(scored, meta, size).withColumn("score", activation(F.col("score")))
    kept = grid.unpad(cells, size, size, scale)
    placed = kept.withColumn(
        "yi", (F.ceil((maxy - F.col("tY")) / scale) + F.col("oy")).cast("int")
    ).withColumn("xi", (F.ceil((F.col("tx") - minx) / scale) + F.col("ox")).cast("int"))
    return patches.overlap_mean(placed, ["t", "band", "yi", "xi"], ["score"], "n")

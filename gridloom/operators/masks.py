"""Filters, QA masks, cloud and shadow masks, band harmonisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions.indices import bits_clear
from gridloom.operators.tiling import drop_halo, focal, with_halo

# QA bit of each mask label, and the six common band names.
QA_BITS = {"cloud": 3, "shadow": 4, "water": 7}
MEDOID_MASK = ("cloud", "shadow", "water")  # what medoid composites leave out by default
COMMON_BANDS = ["B2", "B3", "B4", "B5", "B6", "B7"]
# Source bands per sensor, in the order of the common names.
SENSOR_BANDS = {
    "LT05": ["SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B7"],
    "LE07": ["SR_B1", "SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B7"],
    "LC08": ["SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6", "SR_B7"],
    "LC09": ["SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6", "SR_B7"],
}


def between_dates(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Half-open date filter; the bounds are literals, so they reach the file scan."""
    return df.where((F.col(column) >= F.lit(start).cast("timestamp_ntz"))
                    & (F.col(column) < F.lit(end).cast("timestamp_ntz")))


def below(df: DataFrame, column: str, threshold: float) -> DataFrame:
    return df.where(F.col(column) < threshold)


def scan_scenes(
    scenes: DataFrame, sensors: list[str], start: str, end: str, bounds: dict[str, float]
) -> DataFrame:
    """Archive scan by sensor, half-open date range and box; all three reach the scan."""
    picked = between_dates(scenes.where(F.col("sensor").isin(sensors)), "acquired", start, end)
    return picked.where(
        (F.col("minx") <= bounds["maxx"])
        & (F.col("maxx") >= bounds["minx"])
        & (F.col("miny") <= bounds["maxy"])
        & (F.col("maxy") >= bounds["miny"])
    )


def exclude(df: DataFrame, unwanted: DataFrame, key: str) -> DataFrame:
    """Drop the listed scenes.

    The list is joined as it is: an anti join does not mind repeats, and a plain shuffle on
    both sides lets a scene with very many pixels be split.
    """
    return df.join(unwanted.select(key), key, "left_anti")


def mask_flags(qa: Column, labels: list[str]) -> dict[str, Column]:
    """One "is clear" flag per label."""
    return {label: bits_clear(qa, [QA_BITS[label]]) for label in labels}


def clear_pixels(df: DataFrame, qa: str = "qa", labels: tuple[str, ...] = ("cloud", "shadow")) -> DataFrame:
    """Keep pixels with none of the labelled QA bits set."""
    return df.where(bits_clear(F.col(qa), [QA_BITS[label] for label in labels]))


def null_masked(
    df: DataFrame, bands: list[str], keep: Column
) -> DataFrame:
    """Blank the bands of masked pixels but keep the rows."""
    return df.withColumns({b: F.when(keep, F.col(b)) for b in bands})


def harmonise(df: DataFrame, sensor: str) -> DataFrame:
    """Rename one sensor's bands to the common six and drop the others."""
    source = SENSOR_BANDS[sensor]
    others = [c for c in df.columns if not c.startswith("SR_B")]
    return df.select(
        *others, *[F.col(s).alias(t) for s, t in zip(source, COMMON_BANDS)]
    )


def merge_sensors(collections: dict[str, DataFrame]) -> DataFrame:
    """Harmonise each sensor and stack the collections; nothing is de-duplicated."""
    merged = None
    for sensor, df in collections.items():
        part = harmonise(df, sensor).withColumn("sensor", F.lit(sensor))
        merged = part if merged is None else merged.unionByName(part)
    return merged


def harmonise_mixed(df: DataFrame, sensor: str = "sensor") -> DataFrame:
    """Harmonise a table that holds several sensors, in one scan: the sensor of a row names its bands.

    Rows of an unknown sensor are dropped, as they belong to no collection.
    """
    others = [c for c in df.columns if not c.startswith("SR_B")]
    known = df.where(F.col(sensor).isin(list(SENSOR_BANDS)))

    def band(place: int) -> Column:
        out = F
        for name, source in SENSOR_BANDS.items():
            out = out.when(F.col(sensor) == name, F.col(source[place]))
        return out

    return known.select(*others, *[band(k).alias(t) for k, t in enumerate(COMMON_BANDS)])


def band_columns(df: DataFrame, pattern: str = r"B.*") -> DataFrame:
    """Keep only the columns whose name matches."""
    return df.select(df.colRegex(f"`{pattern}`"))


def cloud_flag(probability: Column, threshold: float = 65.0) -> Column:
    return probability > threshold


def dark_flag(nir: Column, scl: Column, threshold: float = 0.2, scale: float = 1e4) -> Column:
    """Dark and not water; class 6 of the scene classification is water."""
    return (nir < threshold * scale) & (scl != 6)


def cast_shadows(
    raster: DataFrame, keys: list[str], azimuth: str, distance: float = 1.5
) -> DataFrame:
    """Flag dark pixels within ``distance * 10`` pixels of a cloud, away from the sun.

    ``raster`` carries ``yi, xi, is_cloud, is_dark`` and the solar azimuth in degrees.  Only
    cloud pixels are walked along the ray, and the ray's pixels are made distinct before
    they meet the raster on its own key.
    """
    steps = int(round(distance * 10))
    angle = F.radians(90 - F.col(azimuth))
    ray = (
        raster.where("is_cloud")
        .withColumn("step_", F.explode(F.sequence(F.lit(0), F.lit(steps))))
        .select(
            *keys,
            (F.col("yi") + F.round(-F.col("step_") * F.sin(angle)).cast("int")).alias("yi"),
            (F.col("xi") + F.round(F.col("step_") * F.cos(angle)).cast("int")).alias("xi"),
        )
        .distinct()
        .withColumn("on_ray_", F.lit(True))
    )
    return (
        raster.join(ray, [*keys, "yi", "xi"], "left")
        .withColumn("is_shadow", F.coalesce(F.col("on_ray_"), F.lit(False)) & F.col("is_dark"))
        .drop("on_ray_")
    )


def clean_mask(
    raster: DataFrame, keys: list[str], flag: str, shrink: float = 2.0, buffer: float = 50.0,
    tile: int = 256, out: str = "mask",
) -> DataFrame:
    """Shrink then grow a 0/1 mask: focal minimum, then focal maximum, both circular.

    Both passes run inside tiles whose halo covers the two radii, so the raster is
    shuffled once.
    """
    grow = buffer * 2 / 20
    halo = math.ceil(shrink) + math.ceil(grow)
    tiles = with_halo(raster, keys, tile, halo)
    tiles = focal(tiles, keys, flag, shrink, "min", "eroded_")
    tiles = focal(tiles, keys, "eroded_", grow, "max", out)
    return drop_halo(tiles.drop("eroded_"))


def cloud_shadow_mask(
    raster: DataFrame, keys: list[str], probability: str = "prob", nir: str = "nir",
    scl: str = "scl", azimuth: str = "sun_azimuth", threshold: float = 65.0,
    dark: float = 0.2, distance: float = 1.5, buffer: float = 50.0, tile: int = 256,
) -> DataFrame:
    """Cloud and shadow mask of a scene, cleaned; adds ``mask`` as 0/1."""
    flagged = raster.withColumn("is_cloud", cloud_flag(F.col(probability), threshold)).withColumn(
        "is_dark", dark_flag(F.col(nir), F.col(scl), dark)
    )
    shaded = cast_shadows(flagged, keys, azimuth, distance).withColumn(
        "raw_mask", (F.col("is_cloud") | F.col("is_shadow")).cast("int")
    )
    return clean_mask(shaded, keys, "raw_mask", buffer=buffer, tile=tile)

"""Polygons on a grid: chunk filter, spatial joins, rasterising, label cubes.

Spark has no spatial index, and a bare range predicate plans as a nested loop.  A regular
grid makes one unnecessary: a polygon's bounding box names the chunks it can meet by
arithmetic, the exact predicate runs on those candidates before anything is shuffled, and
what remains is an equality join on the chunk position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import rings
from gridloom.operators.grid import densify, with_axis
from gridloom.session import balance

WORD = 62  # planes kept in one 64-bit word


def with_geometry(features: DataFrame, ring: str = "ring") -> DataFrame:
    """Add the bounding box and the edge list of each ring."""
    box = rings.bounds(F.col(ring))
    return features.select(
        "*", *[c.alias(n) for n, c in box.items()], rings.edges(F.col(ring)).alias("edges")
    )


def with_parts_geometry(features: DataFrame, parts: str = "parts") -> DataFrame:
    """Like :func:`with_geometry` for polygons with holes or several parts."""
    all_rings = F.flatten(F.col(parts))
    box = rings.bounds(F.flatten(all_rings))
    return features.select(
        "*", *[c.alias(n) for n, c in box.items()], rings.edges_of_rings(all_rings).alias("edges")
    )


def _touched(lo: Column, hi: Column, g: float) -> Column:
    """Cells of width ``g`` that a closed interval meets, merely touched neighbours included."""
    return F.sequence((F.ceil(lo / g) - 1).cast("int"), F.floor(hi / g).cast("int"))


def polygon_bands(features: DataFrame, maxy: Column, gy: float) -> DataFrame:
    """One row per (polygon, row of cells ``r``) that meet, with the edges that meet the row.

    A polygon over ``n`` rows is cut into some ``sqrt(n)`` pieces and these into their rows, each with
    the edges its parent has kept, so an edge is looked at some ``2 * sqrt(n)`` times and not ``n``.
    The rows are dealt evenly over the cluster at the end, before the real work: neither a huge
    polygon, nor a crowded place, nor a coarse input file stays in one task.
    """
    gy = float(gy)
    bands = features.withColumn("top_", maxy)
    rows = _touched(F.col("top_") - F.col("maxy"), F.col("top_") - F.col("miny"), gy)
    bands = bands.withColumn("r", F.get(rows, F.lit(0))).withColumn("upto_", F.element_at(rows, -1))
    n = F.col("upto_") - F.col("r") + 1
    for height in (F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.least(n, F.lit(4))), F.lit(1)):
        bands = bands.withColumn("step_", height)
        bands = bands.withColumn("from_", F.explode(F.sequence("r", "upto_", "step_")))
        lo, hi = F.col("from_"), F.least(F.col("from_") + F.col("step_") - 1, "upto_")
        high, low = F.col("top_") - lo * gy, F.col("top_") - (hi + 1) * gy
        near = F.filter(
            "edges",
            lambda e: (F.greatest(e["ay"], e["by"]) >= low) & (F.least(e["ay"], e["by"]) <= high),
        )
        whole = (lo == F.col("r")) & (hi == F.col("upto_"))
        bands = bands.withColumns(
            {"edges": F.when(whole, F.col("edges")).otherwise(near), "r": lo, "upto_": hi}
        )
    return balance(bands.drop("from_", "step_", "upto_", "top_"))


def polygon_cells(
    features: DataFrame, minx: Column, maxy: Column, gy: float, gx: float
) -> DataFrame:
    """One row per (polygon, grid cell) that intersect, touching included.

    Needs the columns of :func:`with_geometry`.  The rows of cells of :func:`polygon_bands` are
    cut into cells by :func:`rings.cells_in_band`, whose time grows with edges and cells.  ``edges`` of
    the result are those that meet the row of cells.
    """
    gy, gx = float(gy), float(gx)
    bands = polygon_bands(features, maxy, gy).withColumn("left_", minx).withColumn("top_", maxy)
    high = F.col("top_") - F.col("r") * gy
    cols = _touched(F.col("minx") - F.col("left_"), F.col("maxx") - F.col("left_"), gx)
    bands = bands.withColumns({
        "high_": high, "low_": high - gy, "first_": F.get(cols, F.lit(0)), "last_": F.element_at(cols, -1),
    })
    met = rings.cells_in_band(
        F.col("edges"), F.col("left_"), F.col("low_"), F.col("high_"), gx, F.col("first_"), F.col("last_")
    )
    return bands.withColumn("c", F.explode(met)).drop(
        "left_", "top_", "high_", "low_", "first_", "last_"
    )


def _corner(bounds: DataFrame) -> tuple[Column, Column]:
    return (
        bounds.agg(F.first("minx")).scalar(),
        bounds.agg(F.first("maxy")).scalar(),
    )


def filter_chunks(
    chunks: DataFrame, features: DataFrame, bounds: DataFrame, gy: float, gx: float
) -> DataFrame:
    """Chunks that meet any polygon.  Cells are made distinct before the join, so a chunk
    under a million polygons is one row."""
    minx, maxy = _corner(bounds)
    hit = polygon_cells(features, minx, maxy, gy, gx).select("r", "c").distinct()
    return chunks.join(hit, ["r", "c"], "left_semi")


def chunk_samples(
    chunks: DataFrame,
    features: DataFrame,
    bounds: DataFrame,
    gy: float,
    gx: float,
    date_column: str | None = None,
    time_indices: Column | None = None,
) -> DataFrame:
    """Distinct (chunk, date) pairs of the polygons in each chunk.

    Without a date column every kept chunk is paired with all of ``time_indices``.
    """
    minx, maxy = _corner(bounds)
    cells = polygon_cells(features, minx, maxy, gy, gx)
    if date_column is not None:
        pairs = cells.select("r", "c", date_column).distinct()
        return chunks.join(pairs, ["r", "c"])
    kept = chunks.join(cells.select("r", "c").distinct(), ["r", "c"], "left_semi")
    return with_axis(kept, time_indices, "t")


def boxes_by_chunk(
    boxes: DataFrame, minx: Column, maxy: Column, gy: float, gx: float
) -> DataFrame:
    """Grid cells each box meets, touching included; pure arithmetic, no join."""
    rows = _touched(maxy - F.col("maxy"), maxy - F.col("miny"), float(gy))
    cols = _touched(F.col("minx") - minx, F.col("maxx") - minx, float(gx))
    return boxes.withColumn("r", F.explode(rows)).withColumn("c", F.explode(cols))


def burned_pixels(
    features: DataFrame,
    minx: float,
    maxy: float,
    scale: float,
    by: list[str],
    tile: int = 256,
    extent: tuple[int, int] | None = None,
    distinct: bool = True,
) -> DataFrame:
    """Distinct ``(*by, yi, xi)`` whose pixel centre lies inside a polygon.

    A polygon is cut into rows of ``tile`` pixels first (:func:`polygon_bands` deals the pieces), so
    neither one huge polygon nor one crowded place is expanded in a single task.
    ``distinct=False`` leaves repeats in for a caller that merges them itself.
    ``extent`` is ``(height, width)`` of the raster; pixels outside it are never made.
    """
    s = float(scale)
    left, top = F.lit(float(minx)), F.lit(float(maxy))
    wanted = features.select(*by, "miny", "maxy", "edges")
    pieces = polygon_bands(wanted, top, tile * s)
    # pixel centres sit half a pixel inside the corner labels
    y_lo = F.greatest(
        F.ceil((top - F.col("maxy")) / s - 0.5).cast("int"), F.col("r") * tile, F.lit(0)
    )
    y_hi = F.least(
        F.floor((top - F.col("miny")) / s - 0.5).cast("int"), F.col("r") * tile + tile - 1
    )
    if extent is not None:
        y_hi = F.least(y_hi, F.lit(extent[0] - 1))
    rows = pieces.withColumn("yi", F.explode(F.when(y_lo <= y_hi, F.sequence(y_lo, y_hi))))
    # one crossing test per row, not per pixel: runs of pixels between pairs of crossings
    crossings = rings.row_crossings(F.col("edges"), top - (F.col("yi") + 0.5) * s)
    rows = rows.select(*by, "yi", crossings.alias("x_"))
    runs = rows.withColumn(
        "k_", F.explode(F.when(F.size("x_") >= 2, F.sequence(F.lit(0), F.size("x_") - 2, F.lit(2))))
    )

    def pixel_at(x: Column) -> Column:
        return F.ceil((x - left) / s - 0.5).cast("int")

    x_lo = F.greatest(pixel_at(F.get("x_", F.col("k_"))), F.lit(0))
    x_hi = pixel_at(F.get("x_", F.col("k_") + 1)) - 1
    if extent is not None:
        x_hi = F.least(x_hi, F.lit(extent[1] - 1))
    inside = runs.withColumn("xi", F.explode(F.when(x_lo <= x_hi, F.sequence(x_lo, x_hi))))
    pixels = inside.select(*by, "yi", "xi")
    return pixels.distinct() if distinct else pixels


def rasterise(
    skeleton: DataFrame,
    features: DataFrame,
    minx: float,
    maxy: float,
    scale: float,
    fill: float = 0.0,
    value: float = 1.0,
    tile: int = 256,
) -> DataFrame:
    """``value`` on every skeleton pixel whose centre is inside a polygon, ``fill`` elsewhere."""
    burned = burned_pixels(features, minx, maxy, scale, [], tile).withColumn("burn", F.lit(value))
    return densify(skeleton, burned, ["yi", "xi"], {"burn": fill})


def label_cube(
    skeleton: DataFrame,
    features: DataFrame,
    minx: float,
    maxy: float,
    scale: float,
    label_column: str,
    date_column: str,
    tile: int = 256,
) -> DataFrame:
    """One 0/1 plane per (label, date) over the skeleton pixels.

    Bands follow the sorted labels and times the sorted dates; a combination without
    polygons is a plane of zeros.  Planes are numbered and kept as bits of a word per pixel,
    so the polygons merge into one number per pixel on the map side, the skeleton meets them
    once per pixel and not once per plane, and the planes are unfolded after the join.
    """
    def members(column: str) -> Column:
        return features.agg(F.sort_array(F.collect_set(column))).scalar()

    labels, dates = members(label_column), members(date_column)
    burned = burned_pixels(
        features, minx, maxy, scale, [label_column, date_column], tile, distinct=False
    )
    band = F.array_position(labels, F.col(label_column)) - 1
    step = F.array_position(dates, F.col(date_column)) - 1
    plane = band * F.size(dates) + step
    words = (
        burned.select("yi", "xi", plane.cast("int").alias("plane_"))
        .select(
            "yi", "xi", F.floor(F.col("plane_") / WORD).cast("int").alias("word_"),
            F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("plane_") % WORD).alias("bit_"),
        )
        .groupBy("yi", "xi", "word_")
        .agg(F.bit_or("bit_").alias("bits_"))
    )
    frame = skeleton.withColumn("n_t", F.size(dates)).withColumn("n_", F.size(labels) * F.col("n_t"))
    last = F.floor((F.col("n_") - 1) / WORD).cast("int")
    frame = frame.withColumn("word_", F.explode(F.when(F.col("n_") > 0, F.sequence(F.lit(0), last))))
    joined = frame.join(words, ["yi", "xi", "word_"], "left")
    upto = F.least(F.lit(WORD - 1), F.col("n_") - 1 - F.col("word_") * WORD)
    planes = joined.withColumn("k_", F.explode(F.sequence(F.lit(0), upto)))
    number = F.col("word_") * WORD + F.col("k_")
    lit = F.call_function("getbit", F.coalesce("bits_", F.lit(0).cast("bigint")), F.col("k_"))
    return planes.select(
        *skeleton.columns,
        F.floor(number / F.col("n_t")).cast("int").alias("band"),
        F.pmod(number, F.col("n_t")).cast("int").alias("t"),
        lit.cast("double").alias("value"),
    )


def scene_fraction(scenes: DataFrame, aoi: dict[str, float]) -> DataFrame:
    """Share of the area of interest each scene box covers."""
    box = {k: F.col(k) for k in ("minx", "miny", "maxx", "maxy")}
    target = {k: F.lit(float(v)) for k, v in aoi.items()}
    aoi_area = (aoi["maxx"] - aoi["minx"]) * (aoi["maxy"] - aoi["miny"])
    return scenes.withColumn("fraction", rings.box_overlap_area(box, target) / F.lit(float(aoi_area)))


def scenes_in_bounds(scenes: DataFrame, aoi: dict[str, float]) -> DataFrame:
    """Scenes whose box meets the area of interest."""
    box = {k: F.col(k) for k in ("minx", "miny", "maxx", "maxy")}
    return scenes.where(rings.boxes_touch(box, {k: F.lit(float(v)) for k, v in aoi.items()}))

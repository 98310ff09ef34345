"""Regular grids: chunks, pixel coordinates, dense skeletons, windows on the index space.

A coordinate labels the top-left corner of its pixel: ``lat = maxy - yi * scale`` and
``lon = minx + xi * scale``.  Functions that need an extent take a one-row DataFrame with
``minx, miny, maxx, maxy`` so that it can be computed from the data itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.session import spread


def ceil_index(x: Column) -> Column:
    return F.ceil(x).cast("int")


def floor_index(x: Column) -> Column:
    return F.floor(x).cast("int")


def total_bounds(boxes: DataFrame) -> DataFrame:
    """Extent of a layer of boxes."""
    return boxes.agg(
        F.min("minx").alias("minx"),
        F.min("miny").alias("miny"),
        F.max("maxx").alias("maxx"),
        F.max("maxy").alias("maxy"),
    )


def pixel_extent(pixels: DataFrame) -> DataFrame:
    """Extent spanned by pixel coordinates, first to last label on each axis."""
    return pixels.agg(
        F.min("lon").alias("minx"),
        F.min("lat").alias("miny"),
        F.max("lon").alias("maxx"),
        F.max("lat").alias("maxy"),
    )


def _indices(n: Column) -> Column:
    """``0 .. n-1``, empty for ``n <= 0``."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int")))


def chunk_grid(bounds: DataFrame, gy: float, gx: float) -> DataFrame:
    """Origins of the full chunks inside an extent, row-major; a partial remainder is dropped."""
    rows = bounds.withColumn("nrows_", floor_index((F.col("maxy") - F.col("miny")) / gy)).withColumn(
        "ncols_", floor_index((F.col("maxx") - F.col("minx")) / gx)
    )
    lines = rows.select("minx", "maxy", "ncols_", F.explode(_indices(F.col("nrows_"))).alias("r"))
    return spread(lines, "r").select(
        "*", F.explode(_indices(F.col("ncols_"))).alias("c")
    ).select(
        (F.col("r").cast("bigint") * F.col("ncols_") + F.col("c")).alias("chunk_id"),
        "r",
        "c",
        (F.col("maxy") - F.col("r") * F.lit(float(gy))).alias("ty"),
        (F.col("minx") + F.col("c") * F.lit(float(gx))).alias("tx"),
    )


def coordinate_axes(bounds: DataFrame, gy: float, gx: float, scale: float) -> DataFrame:
    """Pixel coordinates per axis of an extent padded up to a whole chunk.

    An extent that is already exact still gets one more chunk.
    """
    def axis(name: str, extent: Column, g: float, start: Column, step: float) -> DataFrame:
        pad = F.lit(float(g)) - F.pmod(extent, F.lit(float(g)))
        n = floor_index((extent + pad) / scale)
        return bounds.select(
            F.lit(name).alias("axis"), start.alias("start_"), F.explode(_indices(n)).alias("idx")
        ).select("axis", "idx", (F.col("start_") + F.col("idx") * F.lit(float(step))).alias("coord"))

    lat = axis("lat", F.col("maxy") - F.col("miny"), gy, F.col("maxy"), -scale)
    lon = axis("lon", F.col("maxx") - F.col("minx"), gx, F.col("minx"), scale)
    return lat.unionByName(lon)


def chunk_pixels(chunks: DataFrame, height: int, width: int) -> DataFrame:
    """Every pixel ``(yi, xi)`` of the given ``(r, c)`` chunks."""
    ys = F.explode(F.sequence(F.lit(0), F.lit(height - 1)))
    xs = F.explode(F.sequence(F.lit(0), F.lit(width - 1)))
    return (
        spread(chunks, "r", "c")
        .withColumn("dy_", ys)
        .withColumn("dx_", xs)
        .withColumn("yi", (F.col("r") * height + F.col("dy_")).cast("int"))
        .withColumn("xi", (F.col("c") * width + F.col("dx_")).cast("int"))
        .drop("dy_", "dx_")
    )


def densify(
    skeleton: DataFrame, data: DataFrame, on: list[str], fills: dict[str, float | int | None]
) -> DataFrame:
    """The full skeleton with data where there is some and a constant elsewhere."""
    joined = skeleton.join(data, on, "left")
    for name, value in fills.items():
        if value is not None:
            joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def with_axis(df: DataFrame, values: Column, name: str) -> DataFrame:
    """One copy of every row per element of a short dimension array."""
    return df.withColumn(name, F.explode(values))


def region_index(
    df: DataFrame, maxy: float, minx: float, scale: float,
    height: int | None = None, width: int | None = None,
) -> DataFrame:
    """First row and column at or after the coordinate ``(ty, tx)``.

    A coordinate before the first row or column gives 0, one past the last gives their number.
    """
    def first(distance: Column, n: int | None) -> Column:
        index = F.greatest(ceil_index(distance / scale), F.lit(0))
        return index if n is None else F.least(index, F.lit(n))

    return df.withColumn("row0", first(F.lit(maxy) - F.col("ty"), height)).withColumn(
        "col0", first(F.col("tx") - F.lit(minx), width)
    )


def to_indices(df: DataFrame, minx: float, maxy: float, sx: float, sy: float) -> DataFrame:
    return df.withColumn("xi", floor_index((F.col("lon") - minx) / sx)).withColumn(
        "yi", floor_index((F.lit(maxy) - F.col("lat")) / sy)
    )


def box_affine(df: DataFrame, height: int, width: int) -> DataFrame:
    """Pixel size of a ``height x width`` raster that fills a box."""
    return df.withColumn("sx", (F.col("maxx") - F.col("minx")) / width).withColumn(
        "sy", (F.col("maxy") - F.col("miny")) / height
    )


def subset_by_labels(
    df: DataFrame, minx: float, miny: float, maxx: float, maxy: float
) -> DataFrame:
    """Pixels whose coordinate lies in a box, both ends included."""
    return df.where(F.col("lat").between(miny, maxy) & F.col("lon").between(minx, maxx))


def centre_clip(df: DataFrame, height: int | Column, width: int | Column, size: int) -> DataFrame:
    """The centre ``size x size`` pixels, re-indexed; an odd remainder starts at ``diff // 2``."""
    def start(n: int | Column) -> Column:
        n = F.lit(n) if isinstance(n, int) else n
        return floor_index((n - size) / 2)

    y0, x0 = start(height), start(width)
    return (
        df.where((F.col("yi") >= y0) & (F.col("yi") < y0 + size))
        .where((F.col("xi") >= x0) & (F.col("xi") < x0 + size))
        .withColumn("yi", F.col("yi") - y0)
        .withColumn("xi", F.col("xi") - x0)
    )


def centre_crop(df: DataFrame, height: int, width: int, size: int) -> DataFrame:
    """Centre crop whose start is rounded half to even, as image libraries do."""
    y0, x0 = round((height - size) / 2.0), round((width - size) / 2.0)
    return (
        df.where(F.col("yi").between(y0, y0 + size - 1) & F.col("xi").between(x0, x0 + size - 1))
        .withColumn("yi", F.col("yi") - F.lit(y0))
        .withColumn("xi", F.col("xi") - F.lit(x0))
    )


def centre_pad(
    images: DataFrame, data: DataFrame, keys: list[str], height: int, width: int, size: int,
    fills: dict[str, float],
) -> DataFrame:
    """Place every image in the middle of a ``size x size`` frame of a constant.

    ``images`` lists the image keys once; the remainder of an odd difference goes last.
    """
    y0, x0 = (size - height) // 2, (size - width) // 2
    axis = F.sequence(F.lit(0), F.lit(size - 1))
    frame = spread(images.select(*keys), *keys)
    frame = with_axis(with_axis(frame, axis, "yi"), axis, "xi")
    shifted = data.withColumn("yi", (F.col("yi") + y0).cast("int")).withColumn(
        "xi", (F.col("xi") + x0).cast("int")
    )
    return densify(frame, shifted, [*keys, "yi", "xi"], fills)


def nearest_cell(
    points: DataFrame, x: Column, y: Column, bounds: DataFrame, scale: float
) -> DataFrame:
    """Grid cell whose coordinate is nearest to a point; a regular grid needs no search tree.

    ``bounds`` holds the first and last coordinate label per axis; points outside clamp to
    the border.  A tie goes to the smaller index.
    """
    extent = bounds.agg(F.first(F.struct("minx", "miny", "maxx", "maxy"))).scalar()

    def snap(distance: Column, last: Column) -> Column:
        index = F.ceil(distance / scale - 0.5)
        return F.least(F.greatest(index, F.lit(0)), F.floor(last / scale + 0.5)).cast("int")

    return (
        points.withColumn("b_", extent)
        .withColumn("yi", snap(F.col("b_.maxy") - y, F.col("b_.maxy") - F.col("b_.miny")))
        .withColumn("xi", snap(x - F.col("b_.minx"), F.col("b_.maxx") - F.col("b_.minx")))
        .drop("b_")
    )


def patches_around(centres: DataFrame, pixels: DataFrame, size: int) -> DataFrame:
    """Pixels within ``size // 2`` steps of each centre, joined on the cell they fall on.

    The cells of the centres are never broadcast: the planner takes them for as small as the centres.
    """
    k = size // 2
    offsets = F.sequence(F.lit(-k), F.lit(k))
    wanted = (
        centres.withColumn("oy", F.explode(offsets))
        .withColumn("ox", F.explode(offsets))
        .withColumn("yi", F.col("yi") + F.col("oy"))
        .withColumn("xi", F.col("xi") + F.col("ox"))
    )
    return wanted.hint("merge").join(pixels, ["yi", "xi"])


def thin(df: DataFrame, ry: int, rx: int) -> DataFrame:
    """Every ``ry``-th row and ``rx``-th column, re-indexed."""
    return (
        df.where((F.col("yi") % ry == 0) & (F.col("xi") % rx == 0))
        .withColumn("yi", floor_index(F.col("yi") / ry))
        .withColumn("xi", floor_index(F.col("xi") / rx))
    )


def window_pads(
    windows: DataFrame, extent: DataFrame, height: int, width: int, scale: float
) -> DataFrame:
    """How much of each window falls outside the data, and on which side the pad goes.

    Windows carry ``tx, tY`` (left and top); ``extent`` the first and last label per axis.
    A short window is padded at the top when it starts at the first row, else at the
    bottom; at the left when it starts at the first column, else at the right.
    """
    b = extent.agg(F.first(F.struct("minx", "miny", "maxx", "maxy"))).scalar()
    w = windows.withColumn("b_", b)
    w = (
        w.withColumn("ymax", F.least(F.col("tY"), F.col("b_.maxy")))
        .withColumn("ymin", F.greatest(F.col("tY") - (height - 1) * scale, F.col("b_.miny")))
        .withColumn("xmin", F.greatest(F.col("tx"), F.col("b_.minx")))
        .withColumn("xmax", F.least(F.col("tx") + (width - 1) * scale, F.col("b_.maxx")))
    )
    # labels inside the clipped window, which need not sit on the grid itself
    rows = F.floor((F.col("b_.maxy") - F.col("ymin")) / scale) - F.ceil(
        (F.col("b_.maxy") - F.col("ymax")) / scale
    ) + 1
    cols = F.floor((F.col("xmax") - F.col("b_.minx")) / scale) - F.ceil(
        (F.col("xmin") - F.col("b_.minx")) / scale
    ) + 1
    ydiff = (F.lit(height) - F.greatest(rows, F.lit(0))).cast("int")
    xdiff = (F.lit(width) - F.greatest(cols, F.lit(0))).cast("int")
    at_top, at_left = F.col("ymax") == F.col("b_.maxy"), F.col("xmin") == F.col("b_.minx")
    zero = F.lit(0)
    return w.select(
        *windows.columns,
        F.when(at_top, ydiff).otherwise(zero).alias("pad_top"),
        F.when(at_top, zero).otherwise(ydiff).alias("pad_bottom"),
        F.when(at_left, xdiff).otherwise(zero).alias("pad_left"),
        F.when(at_left, zero).otherwise(xdiff).alias("pad_right"),
        F.ceil((F.col("b_.maxy") - F.col("ymax")) / scale).cast("int").alias("row0"),
        F.ceil((F.col("xmin") - F.col("b_.minx")) / scale).cast("int").alias("col0"),
    )


def padded_windows(
    windows: DataFrame, pixels: DataFrame, height: int, width: int, fills: dict[str, float]
) -> DataFrame:
    """Every window as a full ``height x width`` block, padded or filled with constants.

    ``windows`` come from :func:`window_pads`; output rows carry the offset ``(oy, ox)``
    inside the block.
    """
    block = (
        spread(windows, "sample_id")
        .withColumn("oy", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
        .withColumn("ox", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    )
    inside_y = F.col("oy").between(F.col("pad_top"), F.lit(height - 1) - F.col("pad_bottom"))
    inside_x = F.col("ox").between(F.col("pad_left"), F.lit(width - 1) - F.col("pad_right"))
    inside = inside_y & inside_x
    block = block.withColumn(
        "yi", F.when(inside, F.col("row0") + F.col("oy") - F.col("pad_top"))
    ).withColumn("xi", F.when(inside, F.col("col0") + F.col("ox") - F.col("pad_left")))
    # pad cells have no pixel to meet, so they stay out of the join and off its null key
    data = block.where(inside).join(pixels, [c for c in ("yi", "xi", "t") if c in pixels.columns
                                             and c in block.columns], "left")
    pads = block.where(~inside)
    joined = data.unionByName(pads, allowMissingColumns=True)
    for name, value in fills.items():
        joined = joined.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return joined


def unpad(
    blocks: DataFrame, height: int, width: int, scale: float, rescale: int = 1
) -> DataFrame:
    """Drop the padded border of output blocks and shift their origin accordingly.

    Pads are in input pixels and divide by ``rescale``, rounded up.
    """
    def pad(name: str) -> Column:
        return F.ceil(F.col(name) / rescale).cast("int")

    top, bottom, left, right = (pad(f"pad_{s}") for s in ("top", "bottom", "left", "right"))
    return (
        blocks.where((F.col("oy") >= top) & (F.col("oy") < F.lit(height) - bottom))
        .where((F.col("ox") >= left) & (F.col("ox") < F.lit(width) - right))
        .withColumn("tY", F.col("tY") - top * F.lit(float(scale * rescale)))
        .withColumn("tx", F.col("tx") + left * F.lit(float(scale * rescale)))
        .withColumn("oy", F.col("oy") - top)
        .withColumn("ox", F.col("ox") - left)
    )

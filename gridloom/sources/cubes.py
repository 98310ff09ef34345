"""Cube tables: parquet partitioned by tile, or block of tiles, and time step."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions.vectors import nan_to_null
from gridloom.session import cut, spread

FOLDER_PIXELS = 1 << 16


def tile_of(yi: Column, xi: Column, height: int, width: int, across: int | Column) -> Column:
    """Row-major tile number of a pixel."""
    return (F.floor(yi / height) * across + F.floor(xi / width)).cast("int")


def ingest(df: DataFrame, bands: list[str]) -> DataFrame:
    """Bands as stored: NaN becomes NULL once, here, and never again downstream."""
    return df.withColumns({b: nan_to_null(F.col(b)) for b in bands})


def as_float(df: DataFrame, bands: list[str]) -> DataFrame:
    return df.withColumns({b: F.col(b).cast("float") for b in bands})


def tiles_per_folder(pixels: int) -> int:
    """Tiles of so many pixels that one folder holds: some 65,536 pixels together, one tile at least."""
    return max(1, FOLDER_PIXELS // pixels)


def write_tiles(
    df: DataFrame, path: str, partition: tuple[str, ...] = ("tile_id", "t"), tiles: int = 1
) -> None:
    """Write whole tiles; writing a tile again replaces that tile and no other.

    A folder holds ``tiles`` neighbouring tiles of one step as one file, since a folder for each small
    tile costs more than its pixels: numbers ``k * tiles`` to ``(k + 1) * tiles - 1`` lie under
    ``block_=k``.  Tiles have a bounded number of pixels, which bounds the task; the folders spread over
    all tasks.  Where a folder is written again, the tiles that are not replaced are copied into its new
    file.  A stored table is written with the same ``tiles`` each time.
    """
    folders = partition
    if tiles > 1:
        tile, *rest = partition
        folders = ("block_", *rest)
        df = df.withColumn("block_", F.floor(F.col(tile) / tiles).cast("int"))
        stored = _stored(df.sparkSession, path)
        if stored is not None:
            df = cut(df)  # looked up below and written
            touched = _only(stored, df, folders, "left_semi")
            df = df.unionByName(_only(touched, df, (*folders, tile), "left_anti").select(df.columns))
    (
        spread(df, *folders)
        .sortWithinPartitions(*folders, *(partition if tiles > 1 else ()))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
        .parquet(path)
    )


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing or no file there
            return None
        raise


def _only(df: DataFrame, other: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Rows of ``df`` whose keys ``other`` has or lacks; NULL keys are keys like others."""
    k = other.select(*[F.col(c).alias(f"k_{c}") for c in keys]).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in keys]
    return df.join(k, same, how)


def read_cube(spark: SparkSession, path: str | None) -> DataFrame | None:
    """Lazy scan of a cube, or ``None`` for an optional cube without a path."""
    return None if path is None else spark.read.parquet(path).drop("block_")


def with_labels(imagery: DataFrame, labels: DataFrame | None, on: list[str], value: str) -> DataFrame:
    """Imagery with its label column, NULL where labels are absent altogether."""
    if labels is None:
        return imagery.withColumn(value, F.lit(None).cast("double"))
    return imagery.join(labels.select(*on, value), on, "left")


def write_vectors(df: DataFrame, path: str, tile: int = 256) -> None:
    """Per-pixel vectors keyed ``"<y>_<x>"``, grouped into coarse tiles, not one file each."""
    keyed = df.withColumn("key", F.concat_ws("_", F.col("yi").cast("string"), F.col("xi").cast("string")))
    tiled = keyed.withColumn("ty", F.floor(F.col("yi") / tile).cast("int")).withColumn(
        "tx", F.floor(F.col("xi") / tile).cast("int")
    )
    spread(tiled, "ty", "tx").write.mode("overwrite").partitionBy("ty", "tx").parquet(path)


def merge_document(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """New values over old ones; keys only one side knows are kept."""
    n = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values])
    return old.join(n, keys, "full_outer").select(
        *keys, *[F.coalesce(f"new_{v}", v).alias(v) for v in values]
    )


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """The newest committed version of a stored statistics table."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("version")).first()[0]
    return versions.where(F.col("version") == newest).drop("version")


def update_document(
    spark: SparkSession, path: str, new: DataFrame, keys: list[str], values: list[str],
    first: bool = False,
) -> DataFrame:
    """Merge into a stored statistics table and return the new version.

    Versions are numbered partitions beside one another, because a table being read cannot be
    replaced; a version counts from the moment its write is committed, and every update
    starts from the newest one.  ``first`` begins a new table.
    """
    number = 0
    if not first:
        number = spark.read.parquet(path).agg(F.max("version")).first()[0] + 1
        new = merge_document(read_document(spark, path), new, keys, values)
    # the target is named outright, so that a repeated write replaces its own version only
    new.select(*keys, *values).write.mode("overwrite").parquet(f"{path.rstrip('/')}/version={number}")
    return read_document(spark, path)


def display_bands(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """True colour is bands 2, 1, 0; false colour is bands 3, 2, 1."""
    r, g, b = bands[2], bands[1], bands[0]
    fr, fg, fb = bands[3], bands[2], bands[1]
    names = ("red", "green", "blue", "false_red", "false_green", "false_blue")
    return df.select(*keys, *[F.col(c).alias(n) for c, n in zip((r, g, b, fr, fg, fb), names)])


def band_groups(df: DataFrame, keys: list[str], bands: list[str], steps: int, time: str = "t") -> DataFrame:
    """Export groups: ``rgb`` is bands 0-2 and ``ir`` bands 3-5, time labels reversed."""
    groups = F.array(
        F.struct(F.lit("rgb").alias("grp"), *[F.col(b).alias(f"c{i}") for i, b in enumerate(bands[:3])]),
        F.struct(F.lit("ir").alias("grp"), *[F.col(b).alias(f"c{i}") for i, b in enumerate(bands[3:6])]),
    )
    label = (F.lit(steps - 1) - F.col(time)).cast("int").alias("t_label")
    return df.select(*keys, label, F.inline(groups))


def georeference(
    predictions: DataFrame, features: DataFrame, position: str, name: str, height: int, width: int
) -> DataFrame:
    """Attach bounds, CRS and pixel size of the feature whose position leads the file name."""
    from gridloom.functions.text import prediction_position
    from gridloom.operators.grid import box_affine

    placed = predictions.withColumn(position, prediction_position(F.col(name)))
    return box_affine(placed.join(features, position), height, width)

"""Models over pixels and vectors: random forest, linear projection, tile scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from gridloom.operators import forest
from gridloom.operators.patches import flatten_pixels
from gridloom.operators.temporal import reverse_time

IN_DRIVER = 250_000  # leaves of a forest that may grow in the driver, which holds some 1 kB for each


def pixel_features(
    cube: DataFrame, keys: list[str], bands: list[str], time: str, steps: int,
    missing: float = -1.0, reverse: bool = False,
) -> DataFrame:
    """Feature vector per pixel, missing values as a constant, optionally time-reversed."""
    source = reverse_time(cube, steps, time) if reverse else cube
    flat = flatten_pixels(source, keys, bands, time, steps)
    filled = F.transform("features", lambda v: F.coalesce(v.cast("double"), F.lit(missing)))
    return flat.withColumn("features", filled)


def fit_forest(
    df: DataFrame, label: str, features: str = "features", trees: int = 100, depth: int = 16,
    seed: int = 42,
):
    """Random forest on array features; the trees grow distributed over the rows.

    MLlib keeps all nodes in the driver while it fits, and every partition sends the statistics of all
    nodes that grow, so there are no more partitions than tasks that run at a time.  A forest that may
    get more leaves than ``IN_DRIVER`` grows by the same rules where its rows are.
    """
    value = F.col(label).cast("double")
    odd = F.count_if(value.isNull() | (value < 0) | (value != F.floor(value)) | value.isNaN())
    rows, top, odd = df.agg(F.count(F.lit(1)), F.max(value), odd).first()
    if trees * min(2**depth, rows) > IN_DRIVER:
        if odd or top >= 100:
            raise ValueError(f"labels have to be whole numbers from 0 to 99, {label} has {odd} others and {top}")
        return forest.grow(df, label, features, rows, int(top) + 1, trees, depth, seed)
    model = RandomForestClassifier(
        labelCol=label, featuresCol="vector", numTrees=trees, maxDepth=depth, seed=seed,
        predictionCol="prediction", cacheNodeIds=True,
    )
    data = df.withColumn("vector", array_to_vector(F.col(features)))
    return model.fit(data.coalesce(df.sparkSession.sparkContext.defaultParallelism))


def apply_forest(model, df: DataFrame, features: str = "features") -> DataFrame:
    if isinstance(model, forest.Forest):
        return model.transform(df, features)
    data = df.withColumn("vector", array_to_vector(F.col(features)))
    return model.transform(data).drop("vector", "rawPrediction", "probability")


def fit_projection(df: DataFrame, vector: str, k: int = 2):
    """Linear projection to ``k`` dimensions, fitted once."""
    as_vector = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("vector"))
    return PCA(k=k, inputCol="vector", outputCol="projected").fit(as_vector)


def apply_projection(model, df: DataFrame, vector: str, out: str = "projection") -> DataFrame:
    """Re-apply a fitted projection to any set of vectors."""
    data = df.withColumn("vector", array_to_vector(F.col(vector).cast("array<double>")))
    return (
        model.transform(data)
        .withColumn(out, vector_to_array("projected"))
        .drop("vector", "projected")
    )


def pack_blocks(
    blocks: DataFrame, keys: list[str], bands: list[str], order: list[str]
) -> DataFrame:
    """One row per window with a flat array per band, in ``order``.

    A window is at most height x width x steps cells, so the collected group is bounded by
    the window shape and not by the data.
    """
    cells = F.array_sort(F.collect_list(F.struct(*order, *bands)))
    packed = blocks.groupBy(*keys).agg(cells.alias("cells_"))
    # a field of an array of structs is the array of that field
    return packed.select(*keys, *[F.col("cells_")[b].alias(b) for b in bands])


def score_blocks(
    packed: DataFrame,
    keys: list[str],
    bands: list[str],
    shape: tuple[int, ...],
    load: Callable[[], Callable[[np.ndarray], np.ndarray]],
    out_bands: int,
) -> DataFrame:
    """Run a user model over packed windows.

    ``load`` builds the model once per Python worker; the model maps
    ``[n, bands, *shape]`` to ``[n, out_bands, height, width]``.
    """
    kept = packed.select(*keys, *bands)
    fields = [f for f in kept.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    schema += ", output array<array<float>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            if frame.empty:
                continue
            stacked = np.stack(
                [np.stack([np.asarray(v, dtype="float64") for v in frame[b]]) for b in bands], axis=1
            ).reshape(len(frame), len(bands), *shape)
            result = np.asarray(model(stacked), dtype="float32").reshape(len(frame), out_bands, -1)
            yield frame[keys].assign(output=[list(map(list, r)) for r in result])

    return kept.mapInPandas(run, schema)


def unpack_blocks(scored: DataFrame, keys: list[str], width: int, out: str = "score") -> DataFrame:
    """Window outputs back to rows ``(band, oy, ox, value)``."""
    by_band = scored.select(*keys, F.posexplode("output").alias("band", "values_"))
    by_cell = by_band.select(*keys, "band", F.posexplode("values_").alias("pos_", out))
    return by_cell.select(
        *keys,
        "band",
        F.floor(F.col("pos_") / width).cast("int").alias("oy"),
        F.pmod(F.col("pos_"), F.lit(width)).cast("int").alias("ox"),
        out,
    )

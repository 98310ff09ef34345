"""Operators along the integer time axis of a cube.

A pixel has one row per time step, so windows over a pixel hold at most T rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.functions.text import draw_int


def dense_steps(
    df: DataFrame, keys: list[str], bands: list[str], steps: int, fill: float = -1.0, time: str = "t"
) -> DataFrame:
    """Every step ``0 .. steps - 1`` of every pixel; missing steps and bands hold ``fill``.

    ``keys`` and the step identify a row.  A pixel's rows are brought together once and looked up
    by step, so the skeleton is never joined.
    """
    known = F.map_from_entries(F.collect_list(F.struct(F.col(time), F.struct(*bands))))
    inside = df.where(F.col(time).between(0, steps - 1))
    return (
        inside.groupBy(*keys)
        .agg(known.alias("by_step_"))
        .withColumn(time, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
        .select(
            *keys,
            F.col(time).cast("int").alias(time),
            *[
                F.coalesce(F.try_element_at("by_step_", F.col(time))[band], F.lit(fill)).alias(band)
                for band in bands
            ],
        )
    )


def sliding_windows(
    df: DataFrame, keys: list[str], bands: list[str], length: int, steps: int, fill: float = -1.0,
    time: str = "t",
) -> DataFrame:
    """Windows of ``length`` steps that end before anchor ``a``, for ``a`` in ``[length, steps)``.

    Every window is full: steps without a row hold ``fill``.  Each step is copied to the
    anchors whose window holds it; ``k`` is its place there.
    """
    full = dense_steps(df, keys, bands, steps, fill, time)
    lo = F.greatest(F.col(time) + 1, F.lit(length))
    hi = F.least(F.col(time) + length, F.lit(steps - 1))
    anchors = F.explode(F.when(lo <= hi, F.sequence(lo, hi)))
    return full.withColumn("anchor", anchors).withColumn(
        "k", (F.col(time) - F.col("anchor") + length).cast("int")
    )


def asymmetric_windows(
    anchors: DataFrame, df: DataFrame, on: list[str], keys: list[str], bands: list[str],
    window: tuple[int, int], steps: int, offset: int = 0, fill: float = -1.0, time: str = "t",
) -> DataFrame:
    """Steps ``[idx - w0, idx + w1)`` around ``idx = tdx + offset`` for every anchor.

    Windows that leave ``[0, steps)`` are dropped; inside, steps without a row hold ``fill``.
    ``keys`` identify a pixel and contain the anchors' place ``on``.  Anchors expand to their steps,
    so the join is an equality on (place, time).
    """
    back, ahead = window
    idx = F.col("tdx") + offset
    inside = anchors.withColumn("idx", idx.cast("int")).where(
        (idx - back >= 0) & (idx + ahead <= steps)
    )
    wanted = inside.withColumn(
        time, F.explode(F.sequence((F.col("idx") - back).cast("int"), (F.col("idx") + ahead - 1).cast("int")))
    ).withColumn("k", (F.col(time) - F.col("idx") + back).cast("int"))
    return wanted.join(dense_steps(df, keys, bands, steps, fill, time), [*on, time])


def anchor_steps(steps: int, window: tuple[int, int]) -> Column:
    """Anchor indices when features carry no date: ``0 .. steps - sum(window)``."""
    n = steps - (sum(window) - 1)
    return F.sequence(F.lit(0), F.lit(n - 1)) if n > 0 else F.array().cast("array<int>")


def holdout_windows(
    pixels: DataFrame, df: DataFrame, on: list[str], bands: list[str], length: int, holdout: int,
    steps: int, seed: int, epoch: int = 0, fill: float = -1.0, time: str = "t",
) -> DataFrame:
    """Current window and its ``holdout`` shifts back and forward, per sampled pixel.

    The anchor is drawn from ``[length + holdout, steps - holdout)`` by hashing the pixel.  Every
    window is full: steps without a row hold ``fill``.
    """
    span = steps - holdout - (length + holdout)
    keys = [F.col(c) for c in on]
    anchored = pixels.withColumn("anchor", draw_int(keys, seed, span, epoch) + (length + holdout))
    shifted = anchored.withColumn(
        "shift", F.explode(F.sequence(F.lit(-holdout), F.lit(holdout)))
    ).withColumn(
        "segment",
        F.when(F.col("shift") < 0, "bwd").when(F.col("shift") > 0, "fwd").otherwise("cur"),
    )
    first = F.col("anchor") + F.col("shift") - length
    wanted = shifted.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).withColumn(
        time, (first + F.col("k")).cast("int")
    )
    return wanted.join(dense_steps(df, on, bands, steps, fill, time), [*on, time])


def unpack_segments(
    df: DataFrame, size: int, segments: list[str], counts: list[int], time: str = "t"
) -> DataFrame:
    """Split a packed axis into named runs of ``count`` windows of ``size`` steps."""
    window = F.floor(F.col(time) / size).cast("int")
    segment, k, start = F.lit(None).cast("string"), F.lit(None).cast("int"), 0
    for name, count in zip(segments, counts):
        inside = (window >= start) & (window < start + count)
        segment = F.when(inside, F.lit(name)).otherwise(segment)
        k = F.when(inside, window - start).otherwise(k)
        start += count
    return df.select(
        "*",
        segment.alias("segment"),
        k.alias("k"),
        F.pmod(F.col(time), F.lit(size)).cast("int").alias("tt"),
    )


def reverse_time(df: DataFrame, steps: int, time: str = "t") -> DataFrame:
    return df.withColumn(time, (F.lit(steps - 1) - F.col(time)).cast("int"))


def _neighbour(df: DataFrame, keys: list[str], time: str, columns: list[str], ahead: int) -> dict[str, Column]:
    w = W.partitionBy(*keys).orderBy(time)
    here = F.col(time)
    follows = F.lead(time, ahead).over(w) == here + ahead
    return {c: F.when(follows, F.lead(c, ahead).over(w)) for c in columns}


def first_difference(df: DataFrame, keys: list[str], bands: list[str], time: str = "t") -> DataFrame:
    """``x[t+1] - x[t]``; a step without a direct successor gives no row."""
    nxt = _neighbour(df, keys, time, [time, *bands], 1)
    out = df.select(*keys, time, nxt[time].alias("has_"), *[(nxt[b] - F.col(b)).alias(b) for b in bands])
    return out.where(F.col("has_").isNotNull()).drop("has_")


def second_difference(df: DataFrame, keys: list[str], bands: list[str], time: str = "t") -> DataFrame:
    """``x[t+2] - 2 x[t+1] + x[t]`` over three consecutive steps."""
    one = _neighbour(df, keys, time, [time, *bands], 1)
    two = _neighbour(df, keys, time, [time, *bands], 2)
    out = df.select(
        *keys,
        time,
        (one[time] + two[time]).alias("has_"),
        *[(two[b] - 2 * one[b] + F.col(b)).alias(b) for b in bands],
    )
    return out.where(F.col("has_").isNotNull()).drop("has_")


def before_after(df: DataFrame, steps: int, time: str = "t") -> DataFrame:
    """Steps ``T-3`` and ``T-1``, re-indexed to 0 and 1."""
    picked = df.where(F.col(time).isin(steps - 3, steps - 1))
    return picked.withColumn(time, F.when(F.col(time) == steps - 3, 0).otherwise(1))


def frame_delta(
    df: DataFrame, keys: list[str], vector: str, method: str = "delta", time: str = "t"
) -> DataFrame:
    """Latent change between consecutive frames, earlier minus later.

    ``delta`` gives one row per pair of direct successors, none across a missing frame;
    ``cat_delta`` keeps the first frame in front of the deltas; ``stack`` joins all frames end to
    end as they are.
    """
    if method == "delta":
        later = _neighbour(df, keys, time, [vector], 1)[vector]
        return (
            df.select(*keys, time, F.col(vector).alias("a_"), later.alias("b_"))
            .where(F.col("b_").isNotNull())
            .select(*keys, time, F.zip_with("a_", "b_", lambda a, b: a - b).alias(vector))
        )
    frames = df.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(time).alias("t_"), F.col(vector).alias("v_")))
        ).alias("f_")
    )
    f = F.col("f_")
    if method == "stack":
        return frames.select(*keys, F.flatten(F.transform(f, lambda s: s["v_"])).alias(vector))
    if method != "cat_delta":
        raise ValueError(f"unknown method {method!r}")
    n = F.size(f) - 1
    deltas = F.filter(
        F.zip_with(
            F.slice(f, F.lit(1), n), F.slice(f, F.lit(2), n),
            lambda a, b: F.when(
                b["t_"] == a["t_"] + 1, F.zip_with(a["v_"], b["v_"], lambda x, y: x - y)
            ),
        ),
        lambda d: d.isNotNull(),
    )
    first = F.get(f, F.lit(0))["v_"]
    return frames.select(*keys, F.concat(first, F.flatten(deltas)).alias(vector))


def time_index(df: DataFrame, year: str, first_year: Column | int, out: str = "t") -> DataFrame:
    first = F.lit(first_year) if isinstance(first_year, int) else first_year
    return df.withColumn(out, (F.col(year) - first).cast("int"))


def windows_with_labels(
    samples: DataFrame, cube: DataFrame, labels: DataFrame, place: str, pixel: list[str],
    bands: list[str], label: str, steps: int, fill: float = -1.0, time: str = "t",
) -> DataFrame:
    """Sample list with the two imagery steps ``t-1, t`` per pixel and the label at ``t-1``.

    Samples whose window leaves ``[0, steps)`` are dropped.  Missing imagery holds ``fill``, a missing
    label 0.  The list expands to the steps it asks for, so all three tables meet on equality keys.
    """
    inside = samples.where((F.col(time) >= 1) & (F.col(time) < steps))
    wanted = inside.withColumn("step_", F.explode(F.array(F.col(time) - 1, F.col(time))))
    full = dense_steps(cube, [place, *pixel], bands, steps, fill, time)
    imagery = full.select(place, *pixel, F.col(time).alias("step_"), *bands)
    joined = wanted.join(imagery, [place, "step_"]).withColumn("label_step_", F.col(time) - 1)
    target = labels.select(*pixel, F.col(time).alias("label_step_"), label)
    return (
        joined.join(target, [*pixel, "label_step_"], "left")
        .withColumn(label, F.coalesce(label, F.lit(0.0)))
        .withColumn("k", (F.col("step_") - F.col(time) + 1).cast("int"))
        .drop("step_", "label_step_")
    )

"""Scores of predictions against targets, computed from sums that combine on the map side."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.operators.tiling import column_window, drop_halo, row_window, with_halo


def _ratio(a: Column, b: Column) -> Column:
    """``a / b``, zero where ``b`` is zero."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_scores(
    df: DataFrame, score: str, target: str, by: list[str] | None = None, threshold: float = 0.5
) -> DataFrame:
    """Accuracy, Jaccard index, precision and recall of a thresholded score, in one pass."""
    p, t = F.col(score) > threshold, F.col(target) > 0.5
    counts = df.groupBy(*(by or [])).agg(
        F.count_if(p & t).alias("tp"),
        F.count_if(p & ~t).alias("fp"),
        F.count_if(~p & t).alias("fn"),
        F.count_if(~p & ~t).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "*",
        _ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _ratio(tp, tp + fp + fn).alias("jaccard"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
    )


def multiclass_scores(df: DataFrame, pred: str, target: str, num_classes: int) -> DataFrame:
    """Macro accuracy, Jaccard, precision and recall over classes that occur at all.

    The pixels shrink to a confusion matrix first; the rest works on its few cells.
    """
    cells = df.groupBy(F.col(target).alias("t_"), F.col(pred).alias("p_")).agg(
        F.count(F.lit(1)).alias("n_")
    )
    classes = F.explode(F.sequence(F.lit(0), F.lit(num_classes - 1)))
    k, n = F.col("class"), F.col("n_")
    per_class = (
        cells.withColumn("class", classes)
        .groupBy("class")
        .agg(
            F.sum(F.when((F.col("t_") == k) & (F.col("p_") == k), n).otherwise(0)).alias("tp"),
            F.sum(F.when((F.col("t_") != k) & (F.col("p_") == k), n).otherwise(0)).alias("fp"),
            F.sum(F.when((F.col("t_") == k) & (F.col("p_") != k), n).otherwise(0)).alias("fn"),
        )
        .where(F.col("tp") + F.col("fp") + F.col("fn") > 0)
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return per_class.agg(
        F.avg(_ratio(tp, tp + fn)).alias("accuracy"),
        F.avg(_ratio(tp, tp + fp + fn)).alias("jaccard"),
        F.avg(_ratio(tp, tp + fp)).alias("precision"),
        F.avg(_ratio(tp, tp + fn)).alias("recall"),
    )


def regression_scores(df: DataFrame, pred: str, target: str, by: list[str] | None = None) -> DataFrame:
    d = F.col(pred).cast("double") - F.col(target).cast("double")
    return df.groupBy(*(by or [])).agg(
        F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse")
    )


def reduce_rows(df: DataFrame, value: str, reduction: str, out: str = "loss") -> DataFrame:
    """``none`` keeps the rows, ``mean`` and ``sum`` reduce them to one."""
    if reduction == "none":
        return df
    agg = {"mean": F.avg, "sum": F.sum}[reduction]
    return df.agg(agg(value).alias(out))


def overlap_losses(
    df: DataFrame, keys: list[str], cls: str, prob: str, target: str, eps: float = 1e-6,
    ignore: list[int] | None = None,
) -> DataFrame:
    """Dice and Jaccard loss per (image, class) from three sums per class."""
    sums = overlap_sums(df, keys, cls, prob, target, ignore)
    i, p, t = F.col("i_"), F.col("p_"), F.col("t_")
    return sums.select(
        *keys,
        cls,
        (1 - (2 * i + eps) / (p + t + eps)).alias("dice_loss"),
        (1 - (i + eps) / (p + t - i + eps)).alias("jaccard_loss"),
    )


def overlap_sums(
    df: DataFrame, keys: list[str], cls: str, prob: str, target: str, ignore: list[int] | None = None
) -> DataFrame:
    if ignore:
        df = df.where(~F.col(cls).isin(ignore))
    p, t = F.col(prob).cast("double"), F.col(target).cast("double")
    return df.groupBy(*keys, cls).agg(
        F.sum(p * t).alias("i_"), F.sum(p).alias("p_"), F.sum(t).alias("t_")
    )


def image_losses(
    df: DataFrame, keys: list[str], cls: str, prob: str, target: str,
    alpha: float = 0.5, beta: float = 0.5, eps: float = 1e-6, ignore: list[int] | None = None,
) -> DataFrame:
    """Generalised Dice (class weight ``1 / (target + eps)**2``) and Tversky loss per image."""
    sums = overlap_sums(df, keys, cls, prob, target, ignore)
    i, p, t = F.col("i_"), F.col("p_"), F.col("t_")
    w = 1 / F.pow(t + eps, F.lit(2.0))
    totals = sums.groupBy(*keys).agg(
        F.sum(w * i).alias("wi_"), F.sum(w * (p + t)).alias("wpt_"),
        F.sum("i_").alias("tp_"), F.sum(p - i).alias("fp_"), F.sum(t - i).alias("fn_"),
    )
    tp = F.col("tp_")
    return totals.select(
        *keys,
        (1 - (2 * F.col("wi_") + eps) / (F.col("wpt_") + eps)).alias("generalised_dice_loss"),
        (1 - (tp + eps) / (tp + alpha * F.col("fp_") + beta * F.col("fn_") + eps)).alias("tversky_loss"),
    )


def gaussian_weights(sigma: float, size: int) -> list[float]:
    half = size // 2
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def ssim_map(
    df: DataFrame, keys: list[str], pred: str, target: str, data_range: float | None = 1.0,
    kernel: str = "uniform", size: int = 7, sigma: float = 1.5, k1: float = 0.01,
    k2: float = 0.03, tile: int = 256,
) -> DataFrame:
    """Structural similarity of every pixel whose full window lies inside the image.

    The window is separable: one pass along rows, one down columns, both inside tiles that
    already hold their halo, so the image is shuffled once.  ``uniform`` uses the sample
    covariance, ``gaussian`` the weighted population covariance.  Without a ``data_range``
    the wider of the two value ranges is used.  Images must be dense.
    """
    half = size // 2
    x, y = F.col(pred).cast("double"), F.col(target).cast("double")
    terms = {"x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    tiles = with_halo(
        df.select(*keys, "yi", "xi", *[c.alias(f"{n}_") for n, c in terms.items()]), keys, tile, half
    )
    weights = gaussian_weights(sigma, size)
    names = [f"{n}_" for n in terms]
    for window, axis in ((row_window, "xi"), (column_window, "yi")):
        near = window(keys, half, half)
        full = F.count(F.lit(1)).over(near) == size
        if kernel == "uniform":
            sums = {n: F.avg(n).over(near) for n in names}
        else:
            # a full window is gapless, so row offsets are pixel offsets
            across = "yi" if axis == "xi" else "xi"
            line = W.partitionBy(*keys, "ty_", "tx_", across).orderBy(axis)
            shifts = {
                f"at{d}_": F.lead(F.struct(*names), d - half).over(line) for d in range(size)
            }
            tiles = tiles.withColumns({**shifts, "full_": full})
            full = F.col("full_")
            sums = {
                n: sum((F.col(f"at{d}_")[n] * w for d, w in enumerate(weights)), F.lit(0.0))
                for n in names
            }
        tiles = tiles.withColumns({n: F.when(full, c) for n, c in sums.items()})
        tiles = tiles.drop("full_", *[f"at{d}_" for d in range(size)])
    correct = size**2 / (size**2 - 1) if kernel == "uniform" else 1.0
    mx, my = F.col("x_"), F.col("y_")
    vx = (F.col("xx_") - mx * mx) * correct
    vy = (F.col("yy_") - my * my) * correct
    vxy = (F.col("xy_") - mx * my) * correct
    span = F.lit(data_range) if data_range is not None else df.agg(
        F.greatest(F.max(pred) - F.min(pred), F.max(target) - F.min(target))
    ).scalar()
    c1, c2 = F.pow(k1 * span, F.lit(2.0)), F.pow(k2 * span, F.lit(2.0))
    value = ((2 * mx * my + c1) * (2 * vxy + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))
    return (
        drop_halo(tiles.withColumn("ssim", value))
        .where(F.col("ssim").isNotNull())
        .select(*keys, "yi", "xi", "ssim")
    )


def ssim(df: DataFrame, keys: list[str], pred: str, target: str, **options) -> DataFrame:
    """Mean structural similarity per image."""
    return ssim_map(df, keys, pred, target, **options).groupBy(*keys).agg(F.avg("ssim").alias("ssim"))


def gradient_magnitudes(
    grads: DataFrame, layers: list[str], freq: int, step: str = "step", name: str = "name",
    value: str = "value",
) -> DataFrame:
    """Mean L2 norm of parameter gradients per (step, layer), every ``freq`` steps.

    A parameter counts towards every layer whose name it contains.  Norms combine on the
    map side; the layer list is configuration, so matching needs no join.
    """
    norms = (
        grads.where(F.col(step) % freq == 0)
        .groupBy(step, name)
        .agg(F.sqrt(F.sum(F.col(value) * F.col(value))).alias("norm_"))
    )
    wanted = F.filter(F.array(*[F.lit(x) for x in layers]), lambda x: F.contains(F.col(name), x))
    return (
        norms.withColumn("layer", F.explode(wanted))
        .groupBy(step, "layer")
        .agg(F.avg("norm_").alias("avgmag"))
    )


def ssim_loss(df: DataFrame, keys: list[str], pred: str, target: str, **options) -> DataFrame:
    """One minus the mean structural similarity of each image."""
    return ssim(df, keys, pred, target, **options).select(*keys, (1 - F.col("ssim")).alias("loss"))

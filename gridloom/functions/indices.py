"""Band arithmetic: spectral indices, rescaling, normalisation and per-pixel losses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gridloom.functions.vectors import log_sum_exp, sigmoid


def normalised_difference(a: Column, b: Column) -> Column:
    """``(a - b) / (a + b)``; NULL where both are zero."""
    return F.try_divide(a - b, a + b)


def ndvi(nir: Column, red: Column) -> Column:
    return normalised_difference(nir, red)


def ndwi(nir: Column, swir: Column) -> Column:
    return normalised_difference(nir, swir)


def nbr(nir: Column, swir: Column) -> Column:
    return normalised_difference(nir, swir)


def rescale(x: Column, factor: float, offset: float = 0.0) -> Column:
    return x * F.lit(factor) + F.lit(offset)


def surface_reflectance(x: Column) -> Column:
    """Stored integers to reflectance; fixed values of the archive's scaling."""
    return rescale(x, 0.0000275, -0.2)


def binary_step(x: Column) -> Column:
    return F.when(x > 0, F.lit(1.0)).otherwise(F.lit(0.0))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def stretch(x: Column, low: Column, high: Column) -> Column:
    """Display stretch to [0, 1]; a flat range gives NULL."""
    return clamp01(F.try_divide(x - low, high - low))


def bits_clear(qa: Column, bits: list[int]) -> Column:
    """True where none of the given bit positions is set."""
    mask = 0
    for bit in bits:
        mask |= 1 << bit
    return qa.bitwiseAND(F.lit(mask)) == 0


def bce_with_logits(x: Column, target: Column, weight: float = 1.0, pos_weight: float = 1.0) -> Column:
    """Binary cross-entropy on a logit, with the log-sum-exp form that cannot overflow."""
    softplus_neg = F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    return F.lit(weight) * ((1 - target) * x + (1 + (pos_weight - 1) * target) * softplus_neg)


def focal(x: Column, target: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """Focal loss on a logit; a negative ``alpha`` switches the class weighting off."""
    p = sigmoid(x)
    p_true = p * target + (1 - p) * (1 - target)
    loss = bce_with_logits(x, target) * F.pow(1 - p_true, F.lit(float(gamma)))
    if alpha < 0:
        return loss
    return loss * (alpha * target + (1 - alpha) * (1 - target))


def cross_entropy(
    logits: Column, target: Column, num_classes: int, label_smoothing: float = 0.0,
    weights: list[float] | None = None, ignore_index: int = -100,
) -> Column:
    """Cross-entropy of one pixel from an array of logits and a class index.

    A pixel of the ignored class has no loss (NULL), so means and sums pass over it.

    Smoothing spreads ``label_smoothing / num_classes`` over all classes.  With class
    weights the value is the weighted loss; the mean then divides by the target weights.
    """
    log_z = log_sum_exp(logits)
    picked = log_z - F.get(logits, target)
    w = F.lit(1.0)
    if weights is not None:
        w = F.get(F.array(*[F.lit(float(v)) for v in weights]), target)
    loss = w * picked
    if label_smoothing:
        per_class = weights or [1.0] * num_classes
        smooth = F.lit(0.0)
        for k, wk in enumerate(per_class):
            smooth = smooth + F.lit(float(wk)) * (log_z - F.get(logits, F.lit(k)))
        loss = (1 - label_smoothing) * loss + (label_smoothing / num_classes) * smooth
    # added, not wrapped around: a condition would stop losses from sharing the exponentials
    return loss + F.when(target != ignore_index, F.lit(0.0))

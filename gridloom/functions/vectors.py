"""Arithmetic over ``ARRAY`` vectors; all accumulation is in DOUBLE."""

from __future__ import annotations


from pyspark.sql import Column, functions as F


def _sum(v: Column, term) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + term(x.cast("double")))


def total(v: Column) -> Column:
    return _sum(v, lambda x: x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column) -> Column:
    return F.sqrt(_sum(v, lambda x: x * x))


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def l1(a: Column, b: Column) -> Column:
    return _sum(difference(a, b), F.abs)


def l2(a: Column, b: Column) -> Column:
    return norm(difference(a, b))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    """Cosine similarity; each norm is floored by ``eps``."""
    floor = F.lit(eps)
    return dot(a, b) / (F.greatest(norm(a), floor) * F.greatest(norm(b), floor))


def normalise(v: Column, eps: float = 1e-12) -> Column:
    """Unit L2 length; the norm is floored so that a zero vector stays zero."""
    length = F.greatest(norm(v), F.lit(eps))
    return F.transform(v, lambda x: x.cast("double") / length)


def sub_range(v: Column, start: int, stop: int) -> Column:
    """Elements ``[start, stop)`` counted from zero."""
    return F.slice(v, start + 1, stop - start)


def drop_leading_token(v: Column, max_len: int) -> Column:
    """Drop the first element of a vector longer than ``max_len``."""
    return F.when(F.size(v) > max_len, F.slice(v, F.lit(2), F.size(v) - 1)).otherwise(v)


def sigmoid(x: Column) -> Column:
    """Logistic function, in the form whose exponent never overflows."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_sum_exp(v: Column) -> Column:
    top = F.array_max(v)
    return top + F.ln(_sum(v, lambda x: F.exp(x - top)))


def softmax(v: Column) -> Column:
    top = F.array_max(v)
    shifted = F.transform(v, lambda x: F.exp(x - top))
    denominator = total(shifted)
    return F.transform(shifted, lambda x: x / denominator)


def argmax(v: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def nan_to_null(x: Column) -> Column:
    """NaN marks missing data in array stores; NULL is what aggregates skip."""
    return F.when(~F.isnan(x), x)

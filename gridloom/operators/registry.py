"""Steps by name: configuration lists become ``df.transform`` chains."""

from __future__ import annotations

import importlib
import inspect
from collections.abc import Callable, Iterable
from datetime import date

from pyspark.sql import DataFrame, functions as F

Step = Callable[..., DataFrame]
_STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Register ``fn(df, **args)`` under a name."""
    def keep(fn: Step) -> Step:
        _STEPS[name] = fn
        return fn

    return keep


def find_step(name: str) -> Step:
    """A registered step, or the function at a dotted path."""
    if name in _STEPS:
        return _STEPS[name]
    module, _, attribute = name.rpartition(".")
    if not module:
        raise KeyError(f"unknown step {name!r}; known: {sorted(_STEPS)}")
    return getattr(importlib.import_module(module), attribute)


def apply_steps(df: DataFrame, config: Iterable[dict], **injected) -> DataFrame:
    """Run ``[{"name": ..., "args": {...}}, ...]``.

    A name with dots is the path of a function of the user's own, whose first argument is the
    DataFrame.  Injected values reach only the steps that name them, so a shared context can be
    passed to a chain.  Steps see whole DataFrames and therefore stay inside one Spark plan.
    """
    for item in config:
        fn = find_step(item["name"])
        wanted = inspect.signature(fn).parameters
        extra = {k: v for k, v in injected.items() if k in wanted}
        df = fn(df, **{**extra, **item.get("args", {})})
    return df


@step("clear_pixels")
def _clear(df: DataFrame, labels: Iterable[str] = ("cloud", "shadow")) -> DataFrame:
    from gridloom.operators.masks import clear_pixels

    return clear_pixels(df, labels=tuple(labels))


@step("median")
def _median(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    from gridloom.operators.composites import median_composite

    return median_composite(df, keys, bands)


@step("medoid")
def _medoid(df: DataFrame, keys: list[str], bands: list[str], tie_break: list[str]) -> DataFrame:
    from gridloom.operators.composites import medoid_composite

    return medoid_composite(df, keys, bands, tie_break)


@step("monthly_medoid")
def _monthly(
    df: DataFrame, day: str, start: date, end: date, pixel: list[str], bands: list[str], tie_break: list[str]
) -> DataFrame:
    from gridloom.operators.composites import monthly_medoid

    return monthly_medoid(df, F.to_date(day), start, end, pixel, bands, tie_break)


@step("window_median")
def _window_median(
    df: DataFrame, day: str, windows: list[tuple[str, date, date]], pixel: list[str], bands: list[str]
) -> DataFrame:
    from gridloom.operators.composites import window_median

    return window_median(df, F.to_date(day), windows, pixel, bands)


@step("burn_labels")
def _burn(df: DataFrame, features: DataFrame, minx: float, maxy: float, scale: float, tile: int = 256) -> DataFrame:
    """Annotator: 1 on pixels of the frame under a polygon of ``features``, 0 elsewhere."""
    from gridloom.operators.polygons import rasterise

    return rasterise(df, features, minx, maxy, scale, tile=tile)


@step("sliding_windows")
def _windows(
    df: DataFrame, keys: list[str], bands: list[str], length: int, steps: int, fill: float = -1.0
) -> DataFrame:
    from gridloom.operators.temporal import sliding_windows

    return sliding_windows(df, keys, bands, length, steps, fill)


@step("epoch_sample")
def _sample(df: DataFrame, keys: list[str], ratio: float, seed: int, epoch: int = 0) -> DataFrame:
    from gridloom.operators.sampling import epoch_sample

    return epoch_sample(df, keys, ratio, seed=seed, epoch=epoch)


@step("append_index")
def _index(df: DataFrame, index: str, a: str, b: str) -> DataFrame:
    from gridloom.functions.indices import normalised_difference

    return df.withColumn(index, normalised_difference(F.col(a), F.col(b)))


@step("normalise")
def _normalise(df: DataFrame, stats: DataFrame, bands: list[str]) -> DataFrame:
    from gridloom.operators.stats import normalise_bands

    return normalise_bands(df, stats, bands)


@step("reverse_time")
def _reverse(df: DataFrame, steps: int, time: str = "t") -> DataFrame:
    from gridloom.operators.temporal import reverse_time

    return reverse_time(df, steps, time)


@step("fill")
def _fill(df: DataFrame, columns: list[str], value: float) -> DataFrame:
    return df.fillna(float(value), subset=columns)

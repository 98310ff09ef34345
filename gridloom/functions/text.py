"""Names, dates and reproducible randomness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The checkpoint and prediction file-name formats that must be read.
CHECKPOINT_NAME = r"epoch=(\d+)_.+=(-?\d+(?:\.\d+)?)(?:-v(\d+))?\.ckpt"
PREDICTION_NAME = r"(\d+)_.+\.pt"


def checkpoint_epoch(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, CHECKPOINT_NAME, 1), F.lit("")).cast("int")


def checkpoint_metric(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, CHECKPOINT_NAME, 2), F.lit("")).cast("double")


def checkpoint_version(path: Column, missing: int = -2) -> Column:
    """The ``-vN`` suffix; a name without one ranks below every version."""
    found = F.nullif(F.regexp_extract(path, CHECKPOINT_NAME, 3), F.lit("")).cast("int")
    return F.coalesce(found, F.lit(missing))


def prediction_position(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, PREDICTION_NAME, 1), F.lit("")).cast("bigint")


def sample_name(image: Column, step: Column) -> Column:
    """Zero-padded ``<image 8>_t<step 2>``."""
    return F.concat(F.lpad(image.cast("string"), 8, "0"), F.lit("_t"), F.lpad(step.cast("string"), 2, "0"))


def parse_date(text: Column) -> Column:
    return F.to_date(text, "yyyy-MM-dd")


def draw(keys: list[Column], seed: int, epoch: int = 0) -> Column:
    """Hex digest that orders rows at random, the same on every run and every cluster."""
    parts = [k.cast("string") for k in keys] + [F.lit(str(seed)), F.lit(str(epoch))]
    return F.md5(F.concat_ws(":", *parts).cast("binary"))


def draw_int(keys: list[Column], seed: int, n: int, epoch: int = 0) -> Column:
    """Reproducible integer in ``[0, n)``, from the first fifteen hex digits (60 bits) of the digest."""
    head = F.conv(F.substring(draw(keys, seed, epoch), 1, 15), 16, 10).cast("bigint")
    return (head % n).cast("int" if n <= 1 << 31 else "bigint")


def draw_unit(keys: list[Column], seed: int, epoch: int = 0) -> Column:
    """Reproducible number in ``[0, 1)``."""
    head = F.conv(F.substring(draw(keys, seed, epoch), 1, 15), 16, 10).cast("bigint").cast("double")
    return head / F.lit(float(16**15))

"""Reproducible sampling and augmentation.

Every random choice is a hash of the row's own key, a seed and the epoch: the same on any
cluster, independent of partitioning, and redrawn when the epoch changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gridloom.functions.indices import clamp01
from gridloom.functions.text import draw_int, draw_unit
from gridloom.operators.ranks import hash_rank, hash_sample, lookup_join


def epoch_sample(df: DataFrame, keys: list[str], ratio: float, seed: int, epoch: int) -> DataFrame:
    """``floor(n * ratio)`` rows without replacement."""
    return hash_sample(df, keys, ratio, seed, epoch)


def patch_corners(pixels: DataFrame, height: int | Column, width: int | Column, size: int) -> DataFrame:
    """Pixels that can be the top-left corner of a full patch."""
    h = F.lit(height) if isinstance(height, int) else height
    w = F.lit(width) if isinstance(width, int) else width
    return pixels.where((F.col("yi") <= h - size) & (F.col("xi") <= w - size))


def jitter_offsets(grid: int, size: int) -> list[int]:
    """Allowed shifts: ``size - grid`` up to, not including, ``grid - size``."""
    return list(range(size - grid, grid - size, size))


def jitter(
    samples: DataFrame, keys: list[str], jitters: int, size: int, gy: int, gx: int, seed: int,
    epoch: int = 0,
) -> DataFrame:
    """Each window ``jitters`` times, shifted by a random multiple of ``size`` on each axis."""
    copies = samples.withColumn("jitter_id", F.explode(F.sequence(F.lit(0), F.lit(jitters - 1))))

    def pick(offsets: list[int], salt: int) -> Column:
        choice = draw_int([F.col(k) for k in keys] + [F.col("jitter_id")], seed + salt, len(offsets), epoch)
        return F.element_at(F.array(*[F.lit(o) for o in offsets]), choice + 1)

    return (
        copies.withColumn("dy", pick(jitter_offsets(gy, size), 0))
        .withColumn("dx", pick(jitter_offsets(gx, size), 1))
        .withColumn("ty", F.col("ty") + F.col("dy"))
        .withColumn("tx", F.col("tx") + F.col("dx"))
    )


def batches(
    df: DataFrame, keys: list[str], size: int, seed: int, epoch: int = 0, drop_last: bool = False
) -> DataFrame:
    """Shuffled batches of ``size`` rows; ``drop_last`` removes a short final batch."""
    ranked = hash_rank(df, keys, seed, epoch, rank_col="rank_")
    out = ranked.withColumn("batch", F.floor(F.col("rank_") / size)).withColumn(
        "slot", F.pmod(F.col("rank_"), F.lit(size)).cast("int")
    )
    if drop_last:
        n = df.agg(F.count(F.lit(1))).scalar()
        out = out.where((F.col("batch") + 1) * size <= n)
    return out.drop("rank_")


def split_by_list(df: DataFrame, splits: DataFrame, keys: list[str]) -> DataFrame:
    """Attach each row's split; rows in no list are dropped."""
    return df.join(splits, keys)


def per_split(df: DataFrame, chains: dict[str, list], split: str = "split") -> DataFrame:
    """Apply each split's own chain of transforms and stack the results."""
    out = None
    for name, chain in chains.items():
        part = df.where(F.col(split) == name)
        for step in chain:
            part = part.transform(step)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def per_split_columns(
    df: DataFrame, chains: dict[str, list[dict[str, Column]]], split: str = "split"
) -> DataFrame:
    """Each split's own chain of column changes in one pass over the rows.

    A step maps column names to their new expressions over the columns as the step before left them.
    Rows of a split without a chain are dropped, as in ``per_split``.
    """
    out = df.where(F.col(split).isin(list(chains)))
    for k in range(max(map(len, chains.values()), default=0)):
        changed: dict[str, Column] = {}
        for name, chain in chains.items():
            for column, expression in (chain[k] if k < len(chain) else {}).items():
                otherwise = changed.get(column, F.col(column))
                changed[column] = F.when(F.col(split) == name, expression).otherwise(otherwise)
        out = out.withColumns(changed)
    return out


def with_choice(
    df: DataFrame, keys: list[str], n: int, seed: int, epoch: int = 0, out: str = "choice"
) -> DataFrame:
    """Which of ``n`` transforms a sample gets; keyed by the sample, so inputs and labels agree."""
    return df.withColumn(out, draw_int([F.col(k) for k in keys], seed, n, epoch))


def apply_choice(df: DataFrame, choice: str, transforms: list[dict[str, Column]]) -> DataFrame:
    """Apply to each row the transform its choice names, in one projection.

    A transform maps column names to their new expressions; the empty one is the identity.
    """
    changed: dict[str, Column] = {}
    for k, transform in enumerate(transforms):
        for name, expression in transform.items():
            otherwise = changed.get(name, F.col(name))
            changed[name] = F.when(F.col(choice) == k, expression).otherwise(otherwise)
    return df.withColumns(changed)


def augment_pair(
    inputs: DataFrame, labels: DataFrame, keys: list[str],
    transforms: list[tuple[dict[str, Column], bool]], seed: int, epoch: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """One random transform per sample, the same for input and label.

    Each transform comes with a flag: set, it leaves the label untouched.  The label gets only
    the expressions for columns it has.
    """
    chosen = [with_choice(d, keys, len(transforms), seed, epoch, "choice_") for d in (inputs, labels)]
    for_label = [
        {} if inputs_only else {n: c for n, c in t.items() if n in labels.columns}
        for t, inputs_only in transforms
    ]
    return (
        apply_choice(chosen[0], "choice_", [t for t, _ in transforms]).drop("choice_"),
        apply_choice(chosen[1], "choice_", for_label).drop("choice_"),
    )


def random_crop(
    df: DataFrame, keys: list[str], height: int, width: int, size: int, seed: int, epoch: int = 0
) -> DataFrame:
    """A random ``size x size`` crop per image, re-indexed."""
    cols = [F.col(k) for k in keys]
    y0 = draw_int(cols, seed, height - size + 1, epoch)
    x0 = draw_int(cols, seed + 1, width - size + 1, epoch)
    return (
        df.withColumn("y0_", y0)
        .withColumn("x0_", x0)
        .where(F.col("yi").between(F.col("y0_"), F.col("y0_") + size - 1))
        .where(F.col("xi").between(F.col("x0_"), F.col("x0_") + size - 1))
        .withColumn("yi", F.col("yi") - F.col("y0_"))
        .withColumn("xi", F.col("xi") - F.col("x0_"))
        .drop("y0_", "x0_")
    )


def rotate(df: DataFrame, quarter_turns: Column, size: int) -> DataFrame:
    """Counter-clockwise quarter turns of a square image, as an index remap."""
    y, x, last = F.col("yi"), F.col("xi"), F.lit(size - 1)
    turned = (
        F.when(quarter_turns == 1, F.struct((last - x).alias("y"), y.alias("x")))
        .when(quarter_turns == 2, F.struct((last - y).alias("y"), (last - x).alias("x")))
        .when(quarter_turns == 3, F.struct(x.alias("y"), (last - y).alias("x")))
        .otherwise(F.struct(y.alias("y"), x.alias("x")))
    )
    return df.withColumn("p_", turned).withColumn("yi", F.col("p_.y")).withColumn(
        "xi", F.col("p_.x")
    ).drop("p_")


def flip(df: DataFrame, horizontal: Column, vertical: Column, height: int, width: int) -> DataFrame:
    return df.withColumn(
        "xi", F.when(horizontal, F.lit(width - 1) - F.col("xi")).otherwise(F.col("xi"))
    ).withColumn("yi", F.when(vertical, F.lit(height - 1) - F.col("yi")).otherwise(F.col("yi")))


def random_affine(
    df: DataFrame, keys: list[str], size: int, seed: int, epoch: int = 0
) -> DataFrame:
    """Random quarter turn, then horizontal and vertical flip with probability one half each."""
    cols = [F.col(k) for k in keys]
    turned = rotate(df, draw_int(cols, seed, 4, epoch), size)
    return flip(
        turned,
        draw_int(cols, seed + 1, 2, epoch) == 1,
        draw_int(cols, seed + 2, 2, epoch) == 1,
        size,
        size,
    )


def colour_jitter(
    df: DataFrame, keys: list[str], bands: list[str], brightness: float, contrast: float,
    seed: int, epoch: int = 0, uniform: bool = True, time: str | None = None,
) -> DataFrame:
    """Brightness ``clamp(f x)`` then contrast ``clamp(f x + (1 - f) mean)`` per band and step.

    ``uniform`` shares the factors over all bands and steps of a sample.  The mean is that of
    the brightened plane; planes are averaged on the map side and looked up by key.
    """
    planes = [*keys, time] if time else list(keys)

    def factor(spread: float, band: str, salt: int) -> Column:
        cols = [F.col(k) for k in (keys if uniform else planes)]
        if not uniform:
            cols.append(F.lit(band))
        lo, hi = max(0.0, 1 - spread), 1 + spread
        return lo + draw_unit(cols, seed + salt, epoch) * (hi - lo)

    bright = df.withColumns({b: clamp01(F.col(b) * factor(brightness, b, 0)) for b in bands})
    means = bright.groupBy(*planes).agg(*[F.avg(b).alias(f"mean_{b}") for b in bands])
    joined = lookup_join(bright, means, planes)
    return joined.withColumns(
        {
            b: clamp01(
                F.col(b) * factor(contrast, b, 1)
                + (1 - factor(contrast, b, 1)) * F.col(f"mean_{b}")
            )
            for b in bands
        }
    ).drop(*[f"mean_{b}" for b in bands])


def class_filter(df: DataFrame, column: str, positions: list[int]) -> DataFrame:
    """Keep the classes at the given places of the sorted distinct class list.

    Classes are made distinct on the map side, and only the first ones up to the last wanted place
    are ranked, so a free-text column is no burden.
    """
    classes = df.select(column).where(F.col(column).isNotNull()).distinct()
    first = classes.orderBy(column).limit(max(positions) + 1)  # bounded by the configuration
    ranked = first.withColumn("place_", F.row_number().over(W.orderBy(column)) - 1)
    wanted = ranked.where(F.col("place_").isin(positions)).select(column)
    return df.join(F.broadcast(wanted), column, "left_semi")


def prepend_background(df: DataFrame, pixel: list[str], cls: str, value: str) -> DataFrame:
    """Class 0 is 1 where all classes of a pixel sum to 0; the others move up by one."""
    background = df.groupBy(*pixel).agg(
        F.when(F.sum(value) == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias(value)
    ).withColumn(cls, F.lit(0))
    shifted = df.withColumn(cls, (F.col(cls) + 1).cast("int"))
    return background.unionByName(shifted.select(*background.columns))

"""Statistics: bands, classes, normalisation, regression, density."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.operators.ranks import lookup_join


def band_stats(cube: DataFrame, bands: list[str], ddof: int = 0) -> DataFrame:
    """Count, mean and standard deviation per band, NULLs skipped.

    One pass with map-side partial moments; the result is unpivoted to a row per band.
    """
    std = F.stddev_samp if ddof else F.stddev_pop
    aggs = []
    for b in bands:
        aggs += [F.count(b).alias(f"{b}_n"), F.avg(b).alias(f"{b}_mean"), std(b).alias(f"{b}_std")]
    wide = cube.agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(b).alias("band"),
                F.col(f"{b}_n").alias("n"),
                F.col(f"{b}_mean").alias("mean"),
                F.col(f"{b}_std").alias("std"),
            )
            for b in bands
        ]
    )
    return wide.select(F.inline(rows))


def class_stats(features: DataFrame, label: str, area: Column) -> DataFrame:
    """Number of polygons and their total area per class."""
    return features.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.sum(area).alias("area"))


def normalise_bands(cube: DataFrame, stats: DataFrame, bands: list[str]) -> DataFrame:
    """Z-score each band with the statistics table; the table has one row per band."""
    by_band = stats.agg(
        F.map_from_entries(
            F.collect_list(F.struct("band", F.struct("mean", "std")))
        )
    ).scalar()
    scored = cube.withColumn("s_", by_band)
    return scored.withColumns(
        {
            b: F.try_divide(F.col(b) - F.col("s_")[b]["mean"], F.col("s_")[b]["std"])
            for b in bands
        }
    ).drop("s_")


def min_max(df: DataFrame, columns: list[str], eps: float = 0.0, source: DataFrame | None = None) -> DataFrame:
    """Scale columns to [0, 1] by their global range, or by the range of another run."""
    source = source if source is not None else df
    ranges = source.agg(
        F.struct(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in columns])
    ).scalar()
    out = df.withColumn("r_", ranges)
    return out.withColumns(
        {
            c: F.try_divide(
                F.col(c) - F.col("r_")[c]["lo"],
                F.col("r_")[c]["hi"] - F.col("r_")[c]["lo"] + F.lit(eps),
            )
            for c in columns
        }
    ).drop("r_")


def linear_fit(df: DataFrame, y: str, x: str, by: list[str] | None = None) -> DataFrame:
    """Least-squares line of ``y`` on ``x`` with its coefficient of determination."""
    return df.groupBy(*(by or [])).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
    )


def density(
    df: DataFrame, x: str, y: str, out: str = "density", step: float = 0.25
) -> DataFrame:
    """Two-dimensional Gaussian kernel density at every sample, Scott bandwidth.

    Samples are whitened by the Cholesky factor of the scaled covariance, so the kernel is
    round with unit width and splits into one pass per axis.  Each sample spreads its weight
    over the four surrounding nodes of a grid of ``step`` bandwidths, node weights are summed
    on the map side, both passes spread node sums over the neighbouring nodes, and the density
    is read back by the same four weights.  The work after the first sum depends on the
    number of occupied nodes, not on the number of samples; no pair of samples is ever made.

    A pass leaves out nodes farther than ``R = sqrt(2 ln(n 2**53))`` bandwidths.  All ``n`` samples
    there would add less than ``n exp(-R * R / 2) = 2**-53``, while a sample alone gives itself
    ``exp(-step * step)`` at least: what is left out is below the rounding of a double, for
    any table.
    """
    moments = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            F.avg(x).alias("mx"),
            F.avg(y).alias("my"),
            F.var_samp(x).alias("sxx"),
            F.var_samp(y).alias("syy"),
            F.covar_samp(x, y).alias("sxy"),
        )
    ).scalar()
    m = F.col("m_")
    factor = F.pow(m["n"].cast("double"), F.lit(-1.0 / 6.0))
    l11 = factor * F.sqrt(m["sxx"])
    l21 = F.pow(factor, 2) * m["sxy"] / l11
    l22 = F.sqrt(F.pow(factor, 2) * m["syy"] - l21 * l21)
    whitened = df.withColumn("m_", moments).withColumn("u_", (F.col(x) - m["mx"]) / l11)
    whitened = whitened.withColumn("v_", (F.col(y) - m["my"] - l21 * F.col("u_")) / l22).withColumn(
        "scale_", 1.0 / (m["n"] * F.lit(2 * 3.141592653589793) * l11 * l22)
    ).drop("m_")
    gu, gv = F.floor(F.col("u_") / step), F.floor(F.col("v_") / step)
    fu, fv = F.col("u_") / step - gu, F.col("v_") / step - gv
    nodes = F.array(
        *[
            F.struct(
                (gu + i).cast("bigint").alias("gu"),
                (gv + j).cast("bigint").alias("gv"),
                ((fu if i else 1 - fu) * (fv if j else 1 - fv)).alias("w"),
            )
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    spread_nodes = whitened.select(F.inline(nodes))
    grid = spread_nodes.groupBy("gu", "gv").agg(F.sum("w").alias("w"))
    beyond = F.sqrt(2 * (F.log(moments.getField("n").cast("double")) + 53 * F.log(F.lit(2.0))))
    steps = F.ceil(beyond / step).cast("bigint")
    kernel = F.exp(-0.5 * F.pow(F.col("d_") * step, F.lit(2.0)))

    def smooth(table: DataFrame, axis: str, other: str) -> DataFrame:
        return (
            table.withColumn("s_", steps)
            .withColumn("d_", F.explode(F.sequence(-F.col("s_"), F.col("s_"))))
            .select(other, (F.col(axis) + F.col("d_")).alias(axis), (F.col("w") * kernel).alias("w"))
            .groupBy(axis, other)
            .agg(F.sum("w").alias("w"))
        )

    field = smooth(smooth(grid, "gu", "gv"), "gv", "gu")
    corners = F.array(
        *[
            F.struct(
                (F.col("gu") - i).alias("gu"), (F.col("gv") - j).alias("gv"),
                F.lit(2 * i + j).alias("corner"), "w",
            )
            for i in (0, 1)
            for j in (0, 1)
        ]
    )
    cells = field.select(F.inline(corners)).groupBy("gu", "gv").agg(
        *[F.max(F.when(F.col("corner") == k, F.col("w"))).alias(f"f{k}_") for k in range(4)]
    )
    # one row per cell meets each sample once, and a crowded cell is looked up in place
    rows = whitened.select(
        *df.columns, "scale_", fu.alias("fu_"), fv.alias("fv_"),
        gu.cast("bigint").alias("gu"), gv.cast("bigint").alias("gv"),
    )
    a, b = F.col("fu_"), F.col("fv_")
    value = (
        (1 - a) * (1 - b) * F.col("f0_") + (1 - a) * b * F.col("f1_")
        + a * (1 - b) * F.col("f2_") + a * b * F.col("f3_")
    )
    return lookup_join(rows, cells, ["gu", "gv"]).select(*df.columns, (value * F.col("scale_")).alias(out))

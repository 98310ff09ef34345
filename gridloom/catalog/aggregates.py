"""Statistics, composites and metric queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gridloom.catalog.base import BANDS, BURN, CHUNK, HITS, MAXY, SCALE, query, r6, rounded, s6
from gridloom.catalog.masking import day
from gridloom.functions import indices, rings
from gridloom.operators import checkpoints, composites, masks, metrics, polygons, stats
from gridloom.operators.ranks import dimension
from gridloom.plans import landcover


def _stats_sql(source: str, std: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{b}' AS band, count({b}) AS n, {s6(f'avg({b})')} AS mean, {s6(f'{std}({b})')} AS std FROM {source}"
        for b in BANDS
    )


@query("a1_band_stats", _stats_sql("{cube}", "stddev_pop"))
def a1(i):
    return rounded(stats.band_stats(i.cube, BANDS), "mean", "std")


@query(
    "a2_band_stats_in_chunks",
    _stats_sql("inside", "stddev_samp"),
    HITS + """,
inside AS (SELECT c.* FROM {cube} c JOIN (SELECT DISTINCT r, c AS cc FROM hits) k
             ON k.r = c.yi // 4 AND k.cc = c.xi // 4)""",
)
def a2(i):
    out = landcover.layer_statistics(i.cube, i.polygons, i.extent, CHUNK, SCALE, BANDS)
    return rounded(out, "mean", "std")


@query(
    "a3_class_stats",
    f"SELECT label, count(*) AS n, {s6('sum(w * h / 2e0)', 3)} AS area FROM {{features}} GROUP BY label",
)
def a3(i):
    return rounded(stats.class_stats(i.polygons, "label", rings.area(F.col("ring"))), "area", digits=3)


CLEAR = "WHERE (qa & 8) = 0 AND (qa & 16) = 0"
DRY = CLEAR + " AND (qa & 128) = 0"


@query(
    "a5_median_composite",
    "SELECT yi, xi, yr, count(*) AS n, "
    + ", ".join(f"{s6(f'median({b})')} AS {b}" for b in BANDS)
    + f" FROM {{observations}} {CLEAR} GROUP BY yi, xi, yr",
)
def a5(i):
    clear = masks.clear_pixels(i.observations)
    out = composites.median_composite(clear, ["yi", "xi", "yr"], BANDS, n_col="n")
    return rounded(out, *BANDS)


TIE = ["acquired", "scene_id", "sensor", "qa", *BANDS]


def _medoid(key: str, source: str, out: str) -> str:
    """Medoid CTEs over ``source`` grouped by ``key``."""
    med = ", ".join(f"median({b}) AS m{k}" for k, b in enumerate(BANDS))
    dist = " + ".join(f"(s.{b} - m{k}) * (s.{b} - m{k})" for k, b in enumerate(BANDS))
    return f"""
{out}_m AS (SELECT {key}, {med} FROM {source} GROUP BY {key}),
{out} AS (SELECT * FROM (
  SELECT s.*, row_number() OVER (PARTITION BY {', '.join('s.' + k.strip() for k in key.split(','))}
         ORDER BY round({dist}, 9), {', '.join('s.' + c for c in TIE)}) AS rn
  FROM {source} s JOIN {out}_m USING ({key})) WHERE rn = 1)"""


@query(
    "a6_annual_medoid",
    f"SELECT yi, xi, yr, CAST(acquired AS DATE) AS day, scene_id, {s6('b1')} AS b1, {s6('b4')} AS b4 FROM med",
    f"""src AS (SELECT * FROM {{observations}} {DRY}
              AND scene_id NOT IN (SELECT scene_id FROM {{scenes}} WHERE cloud_pct >= 95)),"""
    + _medoid("yi, xi, yr", "src", "med"),
)
def a6(i):
    kept = masks.exclude(i.observations, i.scenes.where("cloud_pct >= 95"), "scene_id")
    clear = masks.clear_pixels(kept, labels=masks.MEDOID_MASK)
    out = composites.medoid_composite(clear, ["yi", "xi", "yr"], BANDS, TIE)
    return rounded(out.select("yi", "xi", "yr", day().alias("day"), "scene_id", "b1", "b4"), "b1", "b4")


MONTHS = """
rng AS (SELECT DATE '1995-01-31' AS lo, DATE '1995-03-01' AS hi
        UNION ALL SELECT CAST(m AS DATE), CAST(m + INTERVAL 1 MONTH AS DATE)
        FROM generate_series(TIMESTAMP '1995-03-01', TIMESTAMP '2001-11-01', INTERVAL 1 MONTH) g(m))"""
START, END = date(1995, 1, 31), date(2001, 11, 20)


@query(
    "a7_monthly_medoid",
    f"""SELECT yi, xi, range_start, CAST(acquired AS DATE) AS day, scene_id, {s6('b1')} AS b1, {s6('b4')} AS b4
        FROM med""",
    MONTHS + f""",
src AS (SELECT o.*, lo AS range_start FROM {{observations}} o JOIN rng ON acquired >= lo AND acquired < hi
        {DRY} AND lo >= DATE '1995-06-15'),"""
    + _medoid("yi, xi, range_start", "src", "med"),
)
def a7(i):
    clear = masks.clear_pixels(i.observations, labels=masks.MEDOID_MASK)
    out = composites.monthly_medoid(
        clear, day(), START, END, ["yi", "xi"], BANDS, TIE, first_available=date(1995, 6, 15)
    )
    return rounded(
        out.select("yi", "xi", "range_start", day().alias("day"), "scene_id", "b1", "b4"), "b1", "b4"
    )


AOI = {"minx": 150.0, "miny": 450.0, "maxx": 750.0, "maxy": 900.0}
BEST = MONTHS + """,
frac AS (SELECT scene_id, acquired, greatest(0e0, least(maxx, 750e0) - greatest(minx, 150e0))
           * greatest(0e0, least(maxy, 900e0) - greatest(miny, 450e0)) / 270000e0 AS fraction
         FROM {scenes} WHERE minx <= 750e0 AND maxx >= 150e0 AND miny <= 900e0 AND maxy >= 450e0)"""


@query(
    "a8_best_scene_per_month",
    f"""SELECT range_start, scene_id, {s6('fraction')} AS fraction FROM (
          SELECT lo AS range_start, scene_id, fraction,
                 row_number() OVER (PARTITION BY lo ORDER BY fraction DESC, scene_id) AS rn
          FROM frac JOIN rng ON acquired >= lo AND acquired < hi) WHERE rn = 1""",
    BEST,
)
def a8(i):
    scenes = polygons.scene_fraction(polygons.scenes_in_bounds(i.scenes, AOI), AOI)
    best = composites.best_scene(scenes, day(), START, END)
    return rounded(best.select("range_start", "scene_id", "fraction"), "fraction")


@query(
    "o1_top_scene",
    f"""SELECT sensor, scene_id, {s6('fraction')} AS fraction FROM (
          SELECT s.sensor, s.scene_id, f.fraction,
                 row_number() OVER (PARTITION BY s.sensor ORDER BY f.fraction DESC, s.scene_id) AS rn
          FROM {{scenes}} s JOIN frac f ON f.scene_id = s.scene_id) WHERE rn = 1""",
    BEST,
)
def o1(i):
    from gridloom.operators.ranks import top_row

    scenes = polygons.scene_fraction(polygons.scenes_in_bounds(i.scenes, AOI), AOI)
    top = top_row(scenes, ["sensor"], [("fraction", "desc"), ("scene_id", "asc")])
    return rounded(top.select("sensor", "scene_id", "fraction"), "fraction")


def _windows_sql(rows: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{n}', DATE '{a}', DATE '{b}')" for n, a, b in rows)
    return f"win(period, lo, hi) AS (VALUES {values})"


@query(
    "a9_quarterly_median",
    f"""SELECT yi, xi, period, {s6('median(b1) * 0.0000275e0 - 0.2e0', 9)} AS b1,
               {s6('median(b4) * 0.0000275e0 - 0.2e0', 9)} AS b4
        FROM {{observations}} JOIN win ON acquired >= lo AND acquired < hi {CLEAR} GROUP BY 1, 2, 3""",
    _windows_sql([
        ("q0", "1997-02-10", "1998-05-20"), ("q1", "1997-05-10", "1998-08-20"),
        ("q2", "1997-08-10", "1998-11-20"), ("q3", "1997-11-10", "1999-02-20"),
    ]),
)
def a9(i):
    windows = [
        (f"q{k}", lo, hi)
        for k, (lo, hi) in enumerate(composites.quarter_windows(date(1997, 2, 10), date(1998, 11, 20)))
    ]
    clear = masks.clear_pixels(i.observations)
    out = composites.window_median(clear, day(), windows, ["yi", "xi"], ["b1", "b4"])
    return out.select(
        "yi", "xi", "period", *[r6(indices.surface_reflectance(F.col(b)), 9).alias(b) for b in ("b1", "b4")]
    )


@query(
    "a10_seasonal_median",
    f"""SELECT yi, xi, {', '.join(f'{s6(chr(34) + p + chr(34))} AS "{p}_b1"' for p in
          ('1996_lo', '1996_hi', '1997_lo', '1997_hi'))}
        FROM (PIVOT (SELECT yi, xi, period, b1 FROM {{observations}} JOIN win ON acquired >= lo AND acquired < hi {CLEAR})
              ON period IN ('1996_lo', '1996_hi', '1997_lo', '1997_hi') USING median(b1) GROUP BY yi, xi)""",
    _windows_sql([
        ("1996_lo", "1995-11-01", "1996-03-31"), ("1996_hi", "1996-05-01", "1996-09-30"),
        ("1997_lo", "1996-11-01", "1997-03-31"), ("1997_hi", "1997-05-01", "1997-09-30"),
    ]),
)
def a10(i):
    seasons = composites.season_windows(
        date(1996, 5, 1), date(1997, 9, 30), date(1996, 11, 1), date(1996, 3, 31)
    )
    windows = [(f"{year}_{kind}", lo, hi) for year, kind, lo, hi in seasons]
    clear = masks.clear_pixels(i.observations)
    out = composites.window_median(clear, day(), windows, ["yi", "xi"], ["b1"])
    # two aggregates keep the band in the column name
    names = [w[0] for w in windows]
    wide = out.groupBy("yi", "xi").pivot("period", names).agg(F.first("b1"))
    return wide.select("yi", "xi", *[r6(n).alias(f"{n}_b1") for n in names])


CONFUSION = """
tfpn AS (SELECT img, count(*) FILTER (score > 0.5 AND target > 0.5) AS tp, count(*) FILTER (score > 0.5 AND target <= 0.5) AS fp,
         count(*) FILTER (score <= 0.5 AND target > 0.5) AS fn, count(*) FILTER (score <= 0.5 AND target <= 0.5) AS tn
         FROM {predictions} GROUP BY img)"""


def _rate(a: str, b: str) -> str:
    return s6(f"CASE WHEN {b} = 0 THEN 0 ELSE CAST({a} AS DOUBLE) / ({b}) END")


@query(
    "a15_binary_scores",
    f"""SELECT img, tp, fp, fn, tn, {_rate('(tp + tn)', '(tp + fp + fn + tn)')} AS accuracy,
               {_rate('tp', '(tp + fp + fn)')} AS jaccard, {_rate('tp', '(tp + fp)')} AS precision,
               {_rate('tp', '(tp + fn)')} AS recall FROM tfpn""",
    CONFUSION,
)
def a15(i):
    out = metrics.binary_scores(i.predictions, "score", "target", ["img"])
    return rounded(out, "accuracy", "jaccard", "precision", "recall")


@query(
    "a16_multiclass_scores",
    f"""SELECT {s6('avg(a)')} AS accuracy, {s6('avg(j)')} AS jaccard, {s6('avg(p)')} AS precision, {s6('avg(a)')} AS recall
        FROM (SELECT CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / CAST(tp + fn AS DOUBLE) END AS a,
                     tp / CAST(tp + fp + fn AS DOUBLE) AS j, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / CAST(tp + fp AS DOUBLE) END AS p
              FROM (SELECT k, count(*) FILTER (true_class = k AND pred_class = k) AS tp,
                           count(*) FILTER (true_class <> k AND pred_class = k) AS fp,
                           count(*) FILTER (true_class = k AND pred_class <> k) AS fn
                    FROM {{predictions}}, generate_series(0, 3) g(k) GROUP BY k) WHERE tp + fp + fn > 0)""",
)
def a16(i):
    out = metrics.multiclass_scores(i.predictions, "pred_class", "true_class", 4)
    return rounded(out, "accuracy", "jaccard", "precision", "recall")


def _regression(columns: str) -> str:
    return f"SELECT img, {columns} FROM {{predictions}} GROUP BY img"


@query(
    "a17_mae_mse",
    _regression(f"""{s6('avg(abs(pred_class - true_class))')} AS mae,
                    {s6('avg((pred_class - true_class) * (pred_class - true_class))')} AS mse"""),
)
def a17(i):
    return rounded(
        metrics.regression_scores(i.predictions, "pred_class", "true_class", ["img"]), "mae", "mse"
    ).drop("rmse")


@query("a18_rmse", _regression(f"{s6('sqrt(avg((score - target) * (score - target)))')} AS rmse"))
def a18(i):
    return rounded(metrics.regression_scores(i.predictions, "score", "target", ["img"]).select("img", "rmse"), "rmse")


SSIM = """
win AS (SELECT a.img, a.yi, a.xi, count(*) AS n, avg(b.pred) AS mx, avg(b.target) AS my,
          avg(b.pred * b.pred) AS xx, avg(b.target * b.target) AS yy, avg(b.pred * b.target) AS xy
        FROM {rasters} a JOIN {rasters} b ON a.img = b.img AND b.yi BETWEEN a.yi - 3 AND a.yi + 3
         AND b.xi BETWEEN a.xi - 3 AND a.xi + 3 GROUP BY 1, 2, 3 HAVING count(*) = 49),
px AS (SELECT img, yi, xi, ((2 * mx * my + 0.0001e0) * (2 * (xy - mx * my) * 49 / 48e0 + 0.0009e0))
         / ((mx * mx + my * my + 0.0001e0) * ((xx - mx * mx) * 49 / 48e0 + (yy - my * my) * 49 / 48e0 + 0.0009e0)) AS s
       FROM win)"""


@query("a20_ssim_uniform", f"SELECT img, {s6('avg(s)')} AS ssim FROM px GROUP BY img", SSIM)
def a20(i):
    return rounded(metrics.ssim(i.rasters, ["img"], "pred", "target", tile=16), "ssim")


@query(
    "a20_ssim_gaussian",
    f"SELECT img, {s6('avg(s)')} AS ssim FROM px GROUP BY img",
    """
ker AS (SELECT d, exp(-0.5e0 * d * d / 2.25e0) / (SELECT sum(exp(-0.5e0 * k * k / 2.25e0)) FROM generate_series(-5, 5) h(k)) AS w
        FROM generate_series(-5, 5) g(d)),
win AS (SELECT a.img, a.yi, a.xi, sum(u.w * v.w * b.soft) AS mx, sum(u.w * v.w * b.target) AS my,
          sum(u.w * v.w * b.soft * b.soft) AS xx, sum(u.w * v.w * b.target * b.target) AS yy,
          sum(u.w * v.w * b.soft * b.target) AS xy
        FROM {rasters} a JOIN ker u ON true JOIN ker v ON true
        JOIN {rasters} b ON a.img = b.img AND b.yi = a.yi + u.d AND b.xi = a.xi + v.d
        GROUP BY 1, 2, 3 HAVING count(*) = 121),
px AS (SELECT img, ((2 * mx * my + 0.0001e0) * (2 * (xy - mx * my) + 0.0009e0))
         / ((mx * mx + my * my + 0.0001e0) * ((xx - mx * mx) + (yy - my * my) + 0.0009e0)) AS s FROM win)""",
)
def a20g(i):
    out = metrics.ssim(i.rasters, ["img"], "soft", "target", kernel="gaussian", size=11, tile=16)
    return rounded(out, "ssim")


@query(
    "a19_flat_scores_and_ssim",
    f"""SELECT {_rate('(tp + tn)', 'n')} AS accuracy, {_rate('tp', '(tp + fp + fn)')} AS jaccard,
               {_rate('tp', '(tp + fp)')} AS precision, {_rate('tp', '(tp + fn)')} AS recall,
               (SELECT {s6('avg(s)')} FROM (SELECT avg(s) AS s FROM px GROUP BY img)) AS ssim
        FROM (SELECT count(*) AS n, count(*) FILTER (pred > 0.5 AND target > 0.5) AS tp,
                count(*) FILTER (pred > 0.5 AND target < 0.5) AS fp, count(*) FILTER (pred < 0.5 AND target > 0.5) AS fn,
                count(*) FILTER (pred < 0.5 AND target < 0.5) AS tn FROM {{rasters}})""",
    SSIM,
)
def a19(i):
    flat = metrics.binary_scores(i.rasters, "pred", "target")
    per_image = metrics.ssim(i.rasters, ["img"], "pred", "target", tile=16)
    mean = per_image.agg(F.avg("ssim")).scalar()
    out = flat.select("accuracy", "jaccard", "precision", "recall").withColumn("ssim", mean)
    return rounded(out, *out.columns)


SUMS = """
sums AS (SELECT img, pred_class AS cls, sum(score * target) AS i, sum(score) AS p, sum(target) AS t
         FROM {predictions} GROUP BY 1, 2)"""


@query(
    "a21_soft_overlap_by_class",
    f"""SELECT img, cls, {s6('1 - (2 * i + 1e-6) / (p + t + 1e-6)')} AS dice_loss,
               {s6('1 - (i + 1e-6) / (p + t - i + 1e-6)')} AS jaccard_loss FROM sums WHERE cls <> 2""",
    SUMS,
)
def a21(i):
    p = i.predictions.withColumnRenamed("pred_class", "cls")
    out = metrics.overlap_losses(p, ["img"], "cls", "score", "target", ignore=[2])
    return rounded(out, "dice_loss", "jaccard_loss")


@query(
    "a21_soft_overlap_by_image",
    f"""SELECT img, {s6('1 - (2 * sum(i / pow(t + 1e-6, 2)) + 1e-6) / (sum((p + t) / pow(t + 1e-6, 2)) + 1e-6)')} AS generalised_dice_loss,
               {s6('1 - (sum(i) + 1e-6) / (sum(i) + 0.3e0 * sum(p - i) + 0.7e0 * sum(t - i) + 1e-6)')} AS tversky_loss
        FROM sums GROUP BY img""",
    SUMS,
)
def a21b(i):
    p = i.predictions.withColumnRenamed("pred_class", "cls")
    out = metrics.image_losses(p, ["img"], "cls", "score", "target", alpha=0.3, beta=0.7)
    return rounded(out, "generalised_dice_loss", "tversky_loss")


LSE = "(ln(exp(z0) + exp(z1) + exp(z2)))"
ZT = "(CASE true_class WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END)"


@query(
    "a22_pixel_losses",
    f"""
SELECT img, {s6('avg(bce)')} AS bce, {s6('avg(focal)')} AS focal, {s6('avg(ce)')} AS ce,
       {s6('sum(wce) / sum(wt)')} AS weighted_ce, {s6('avg(smooth)')} AS smoothed_ce,
       {s6('avg(ce) + 1 - (2 * sum(1 / (1 + exp(-z0)) * target) + 1e-6) / (sum(1 / (1 + exp(-z0))) + sum(target) + 1e-6)')} AS dice_ce
FROM (SELECT img, z0, target,
  -(2e0 * target * ln(1 / (1 + exp(-z0))) + (1 - target) * ln(1 / (1 + exp(z0)))) AS bce,
  (CASE WHEN target = 1 THEN 0.25e0 ELSE 0.75e0 END)
    * pow(CASE WHEN target = 1 THEN 1 / (1 + exp(z0)) ELSE 1 / (1 + exp(-z0)) END, 2)
    * ln(1 + exp(CASE WHEN target = 1 THEN -z0 ELSE z0 END)) AS focal,
  {LSE} - {ZT} AS ce,
  (CASE true_class WHEN 0 THEN 1e0 WHEN 1 THEN 2e0 ELSE 0.5e0 END) AS wt,
  (CASE true_class WHEN 0 THEN 1e0 WHEN 1 THEN 2e0 ELSE 0.5e0 END) * ({LSE} - {ZT}) AS wce,
  0.9e0 * ({LSE} - {ZT}) + 0.1e0 / 3 * (3 * {LSE} - z0 - z1 - z2) AS smooth
  FROM {{predictions}}) GROUP BY img""",
)
def a22(i):
    z, t = F.array("z0", "z1", "z2"), F.col("true_class")
    weights = [1.0, 2.0, 0.5]
    p = i.predictions.select(
        "img",
        "target",
        indices.bce_with_logits(F.col("z0"), F.col("target"), pos_weight=2.0).alias("bce"),
        indices.focal(F.col("z0"), F.col("target")).alias("focal"),
        indices.cross_entropy(z, t, 3).alias("ce"),
        indices.cross_entropy(z, t, 3, weights=weights).alias("wce"),
        F.get(F.array(*[F.lit(w) for w in weights]), t).alias("wt"),
        indices.cross_entropy(z, t, 3, label_smoothing=0.1).alias("smooth"),
        _sigmoid("z0").alias("s0"),
    )
    losses = p.groupBy("img").agg(
        F.avg("bce").alias("bce"), F.avg("focal").alias("focal"), F.avg("ce").alias("ce"),
        (F.sum("wce") / F.sum("wt")).alias("weighted_ce"), F.avg("smooth").alias("smoothed_ce"),
    )
    dice = metrics.overlap_losses(p.withColumn("cls", F.lit(0)), ["img"], "cls", "s0", "target")
    out = losses.join(dice.select("img", "dice_loss"), "img").withColumn("dice_ce", F.col("ce") + F.col("dice_loss"))
    return rounded(out.drop("dice_loss"), "bce", "focal", "ce", "weighted_ce", "smoothed_ce", "dice_ce")


def _sigmoid(name: str):
    from gridloom.functions.vectors import sigmoid

    return sigmoid(F.col(name))


CKPT = """
ck AS (SELECT run_id, path, CAST(regexp_extract(path, 'epoch=(\\d+)_', 1) AS INT) AS epoch,
              CAST(regexp_extract(path, '_[^=]+=([0-9.]+[0-9])', 1) AS DOUBLE) AS metric,
              CASE WHEN path LIKE '%-v%' THEN CAST(regexp_extract(path, '-v(\\d+)', 1) AS INT) ELSE -2 END AS version
       FROM {checkpoints})"""


def _pick(order: str) -> str:
    return f"""SELECT run_id, path, epoch, metric, version FROM (
        SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {order}, path) AS rn FROM ck) WHERE rn = 1"""


@query("a24_best_checkpoint", _pick("metric, epoch DESC, version DESC"), CKPT)
def a24(i):
    return checkpoints.best_checkpoint(i.checkpoints)


@query("a25_latest_checkpoint", _pick("epoch DESC, version DESC"), CKPT)
def a25(i):
    return checkpoints.latest_checkpoint(i.checkpoints)


@query(
    "o3_checkpoint_order",
    """SELECT run_id, path, epoch, version,
              row_number() OVER (PARTITION BY run_id ORDER BY epoch DESC, version DESC, path) AS place FROM ck""",
    CKPT,
)
def o3(i):
    return checkpoints.in_order(i.checkpoints).select("run_id", "path", "epoch", "version", "place")


@query(
    "a26_gradient_magnitude",
    f"""SELECT step, layer, {s6('avg(norm)')} AS avgmag FROM
          (SELECT model AS step, name, sqrt(sum(value * value)) AS norm FROM {{params}} WHERE model % 2 = 0 GROUP BY 1, 2)
          JOIN (VALUES ('block_0'), ('block_1'), ('weight')) l(layer) ON contains(name, layer) GROUP BY 1, 2""",
)
def a26(i):
    grads = i.params.withColumnRenamed("model", "step")
    return rounded(metrics.gradient_magnitudes(grads, ["block_0", "block_1", "weight"], 2), "avgmag")


@query(
    "a27_min_max",
    f"""SELECT model, pos, {s6('(value - lo) / (hi - lo + 1e-6)')} AS value, {s6('(value * 2 - lo) / (hi - lo + 1e-6)')} AS other
        FROM {{params}}, (SELECT min(value) AS lo, max(value) AS hi FROM {{params}})""",
)
def a27(i):
    p = i.params.select("model", "pos", "value", (F.col("value") * 2).alias("other"))
    scaled = stats.min_max(p, ["value"], 1e-6)
    # the second column is scaled with the range of the first run
    source = i.params.select(F.col("value").alias("other"))
    return rounded(stats.min_max(scaled, ["other"], 1e-6, source), "value", "other")


@query(
    "a28_linear_fit",
    f"""SELECT t, {s6('regr_slope(b4, b5)')} AS slope, {s6('regr_intercept(b4, b5)')} AS intercept,
               {s6('regr_r2(b4, b5)')} AS r2 FROM {{cube}} GROUP BY t""",
)
def a28(i):
    return rounded(stats.linear_fit(i.cube, "b4", "b5", ["t"]), "slope", "intercept", "r2")


@query(
    "a29_kernel_density",
    f"""
SELECT yi, xi, t, {s6('((1 - fu) * (1 - fv) * a.f + (1 - fu) * fv * b.f + fu * (1 - fv) * c.f + fu * fv * d.f) / (n * 2 * pi() * l11 * l22)')} AS density
FROM white w JOIN field a ON a.gu = w.gu AND a.gv = w.gv JOIN field b ON b.gu = w.gu AND b.gv = w.gv + 1
JOIN field c ON c.gu = w.gu + 1 AND c.gv = w.gv JOIN field d ON d.gu = w.gu + 1 AND d.gv = w.gv + 1""",
    """
mo AS (SELECT count(*) AS n, avg(b4) AS mx, avg(b5) AS my, pow(count(*), -1 / 6e0) AS fac, var_samp(b4) AS sxx,
              var_samp(b5) AS syy, covar_samp(b4, b5) AS sxy FROM {cube}),
ch AS (SELECT *, fac * sqrt(sxx) AS l11, fac * sxy / sqrt(sxx) AS l21,
              sqrt(fac * fac * syy - (fac * sxy / sqrt(sxx)) * (fac * sxy / sqrt(sxx))) AS l22 FROM mo),
uv AS (SELECT yi, xi, t, n, l11, l22, (b4 - mx) / l11 AS u, (b5 - my - l21 * (b4 - mx) / l11) / l22 AS v FROM {cube}, ch),
white AS (SELECT *, CAST(floor(u * 4) AS BIGINT) AS gu, CAST(floor(v * 4) AS BIGINT) AS gv,
                 u * 4 - floor(u * 4) AS fu, v * 4 - floor(v * 4) AS fv FROM uv),
node AS (SELECT gu, gv, sum(w) AS w FROM (
   SELECT gu, gv, (1 - fu) * (1 - fv) AS w FROM white UNION ALL SELECT gu + 1, gv, fu * (1 - fv) FROM white
   UNION ALL SELECT gu, gv + 1, (1 - fu) * fv FROM white UNION ALL SELECT gu + 1, gv + 1, fu * fv FROM white) GROUP BY 1, 2),
need AS (SELECT DISTINCT gu, gv FROM node),
field AS (SELECT q.gu, q.gv, sum(p.w * exp(-0.5e0 * ((q.gu - p.gu) * (q.gu - p.gu) + (q.gv - p.gv) * (q.gv - p.gv)) / 16e0)) AS f
          FROM need q, node p GROUP BY 1, 2)""",
)
def a29(i):
    out = stats.density(i.cube.select("yi", "xi", "t", "b4", "b5"), "b4", "b5")
    return rounded(out.drop("b4", "b5"), "density")


@query(
    "a30_dimension_index",
    """SELECT 'label' AS dim, label AS value, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS idx
       FROM (SELECT DISTINCT label FROM {features})
       UNION ALL SELECT 'yr', CAST(yr AS VARCHAR), CAST(row_number() OVER (ORDER BY yr) - 1 AS INT)
       FROM (SELECT DISTINCT yr FROM {features})""",
)
def a30(i):
    def named(column):
        return dimension(i.features, column, "idx").select(
            F.lit(column).alias("dim"), F.col(column).cast("string").alias("value"), "idx"
        )

    return named("label").unionByName(named("yr"))


def expected_tiles(i):
    """Every tile of the grid at steps 0 to 7."""
    tile = (F.floor(F.col("yi") / 8) * 5 + F.floor(F.col("xi") / 8)).cast("int").alias("tile_id")
    return i.observations.select(tile).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(7))))


@query(
    "a31_tile_progress",
    """SELECT count(*) AS expected, count(s.tile_id) AS written, count(*) - count(s.tile_id) AS missing
       FROM (SELECT DISTINCT CAST(floor(yi / 8e0) * 5 + floor(xi / 8e0) AS INT) AS tile_id, CAST(t AS INT) AS t
             FROM {observations}, generate_series(0, 7) g(t)) e
       LEFT JOIN {splits} s ON s.tile_id = e.tile_id AND s.t = e.t""",
)
def a31(i):
    return checkpoints.tile_progress(expected_tiles(i), i.splits, ["tile_id", "t"])


@query(
    "a31_missing_tiles",
    """SELECT e.tile_id, e.t FROM (
         SELECT DISTINCT CAST(floor(yi / 8e0) * 5 + floor(xi / 8e0) AS INT) AS tile_id, CAST(t AS INT) AS t
         FROM {observations}, generate_series(0, 7) g(t)) e
       ANTI JOIN {splits} s ON s.tile_id = e.tile_id AND s.t = e.t""",
)
def a31b(i):
    return checkpoints.missing_tiles(expected_tiles(i), i.splits, ["tile_id", "t"])


@query(
    "a31_polygons_off_the_grid",
    """SELECT e.fid, e.yr FROM {features} e WHERE NOT EXISTS (
         SELECT 1 FROM burn b WHERE b.fid = e.fid)""",
    BURN,
)
def a31c(i):
    burned = polygons.burned_pixels(i.polygons, 0.0, MAXY, SCALE, ["fid"], tile=16, extent=None)
    tallest = i.observations.agg(F.max("yi")).scalar()
    inside = burned.where((F.col("yi") <= tallest) & (F.col("xi") < 40))
    return checkpoints.missing_tiles(i.features.select("fid", "yr"), inside, ["fid"])


@query(
    "e1_index_by_label",
    f"""SELECT label, yr, {s6('avg(CASE WHEN b4 + b3 <> 0 THEN (b4 - b3) / (b4 + b3) END)')} AS mean_ndvi, count(*) AS pixels
        FROM (SELECT DISTINCT label, yr, yi, xi FROM burn) JOIN {{cube}} USING (yi, xi, yr) GROUP BY label, yr""",
    BURN,
)
def e1(i):
    out = landcover.index_by_label(i.observations, i.polygons, 0.0, MAXY, SCALE)
    return rounded(out, "mean_ndvi")

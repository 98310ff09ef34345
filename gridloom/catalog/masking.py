"""Filter, mask and projection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.base import BANDS, CHUNKS, G, MAXY, query, r6, rounded, s6
from gridloom.catalog.grids import chunks_of
from gridloom.functions import indices, vectors
from gridloom.operators import composites, masks, pairs, polygons
from gridloom.operators.sampling import class_filter
from gridloom.sources import cubes

def day():
    return F.col("acquired").cast("date")


@query(
    "s3_scene_scan",
    """SELECT scene_id, sensor, CAST(acquired AS DATE) AS day FROM {scenes}
       WHERE sensor IN ('LT05', 'LC08') AND acquired >= '1996-01-01' AND acquired < '1999-07-01'
         AND minx <= 500e0 AND maxx >= 200e0 AND miny <= 900e0 AND maxy >= 300e0""",
)
def s3(i):
    found = masks.scan_scenes(
        i.scenes, ["LT05", "LC08"], "1996-01-01", "1999-07-01",
        {"minx": 200.0, "miny": 300.0, "maxx": 500.0, "maxy": 900.0},
    )
    return found.select("scene_id", "sensor", day().alias("day"))


@query(
    "p1_date_filter",
    """SELECT yr, sensor, count(*) AS n FROM {observations}
       WHERE acquired >= '1996-03-16' AND acquired < '1999-10-01' GROUP BY yr, sensor""",
)
def p1(i):
    return masks.between_dates(i.observations, "acquired", "1996-03-16", "1999-10-01").groupBy(
        "yr", "sensor"
    ).agg(F.count(F.lit(1)).alias("n"))


@query("p2_property_filter", "SELECT scene_id, cloud_pct FROM {scenes} WHERE cloud_pct < 30")
def p2(i):
    return masks.below(i.scenes, "cloud_pct", 30).select("scene_id", "cloud_pct")


@query(
    "p3_scenes_per_chunk",
    """SELECT chunk_id, count(*) AS n, max(scene_id) AS newest
       FROM chunks k JOIN {scenes} s ON s.minx <= tx + 120e0 AND s.maxx >= tx
                                    AND s.miny <= ty AND s.maxy >= ty - 120e0
       GROUP BY chunk_id""",
    CHUNKS,
)
def p3(i):
    cells = polygons.boxes_by_chunk(i.scenes, F.lit(0.0), F.lit(MAXY), G, G)
    per_cell = cells.groupBy("r", "c").agg(
        F.count(F.lit(1)).alias("n"), F.max("scene_id").alias("newest")
    )
    return chunks_of(i).join(per_cell, ["r", "c"]).select("chunk_id", "n", "newest")


@query(
    "p3_filter_bounds",
    """SELECT scene_id FROM {scenes}
       WHERE minx <= 750e0 AND maxx >= 150e0 AND miny <= 900e0 AND maxy >= 450e0""",
)
def p3b(i):
    aoi = {"minx": 150.0, "miny": 450.0, "maxx": 750.0, "maxy": 900.0}
    return polygons.scenes_in_bounds(i.scenes, aoi).select("scene_id")




def raw_sensors(i):
    """Observations of all sensors with seven source bands."""
    o = i.observations.select(
        "scene_id", "yi", "xi", "sensor", *[F.col(f"b{k}").alias(f"SR_B{k}") for k in range(1, 7)],
        (F.col("b1") + F.col("b4")).alias("SR_B7"),
    )
    return o


def by_sensor(i):
    """The same as separate tables, as archives keep them."""
    o = raw_sensors(i)
    return {s: o.where(F.col("sensor") == s).drop("sensor") for s in ("LT05", "LE07", "LC08", "LC09")}


HARMONISED = f"""
SELECT scene_id, yi, xi, sensor,
  {s6("CASE WHEN sensor IN ('LC08', 'LC09') THEN b2 ELSE b1 END")} AS "B2",
  {s6("CASE WHEN sensor IN ('LC08', 'LC09') THEN b3 ELSE b2 END")} AS "B3",
  {s6("CASE WHEN sensor IN ('LC08', 'LC09') THEN b4 ELSE b3 END")} AS "B4",
  {s6("CASE WHEN sensor IN ('LC08', 'LC09') THEN b5 ELSE b4 END")} AS "B5",
  {s6("CASE WHEN sensor IN ('LC08', 'LC09') THEN b6 ELSE b5 END")} AS "B6",
  {s6("b1 + b4")} AS "B7"
FROM {{observations}}"""


@query("p4_sensor_harmonisation", HARMONISED)
def p4(i):
    return rounded(masks.harmonise_mixed(raw_sensors(i)), *masks.COMMON_BANDS)


@query(
    "u1_merge_collections",
    f"SELECT sensor, count(*) AS n, {s6('sum(' + chr(34) + 'B7' + chr(34) + ')', 4)} AS b7 FROM h GROUP BY sensor",
    "h AS (" + HARMONISED.strip() + ")",
)
def u1(i):
    merged = rounded(masks.merge_sensors(by_sensor(i)), "B7")
    return merged.groupBy("sensor").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("B7"), 4).alias("b7")
    )


@query(
    "p5_qa_bit_mask",
    f"""SELECT scene_id, yi, xi, qa, CASE WHEN (qa & 8) = 0 AND (qa & 16) = 0 THEN {s6('b4')} END AS b4
        FROM {{observations}}""",
)
def p5(i):
    blank = masks.null_masked(i.observations, ["b4"], indices.bits_clear(F.col("qa"), [3, 4]))
    return blank.select("scene_id", "yi", "xi", "qa", r6("b4").alias("b4"))


@query(
    "p6_mask_labels",
    """SELECT sensor, yr, count(*) AS n, count(CASE WHEN (qa & 8) = 0 THEN 1 END) AS cloud_free,
              count(CASE WHEN (qa & 16) = 0 THEN 1 END) AS shadow_free,
              count(CASE WHEN (qa & 8) = 0 AND (qa & 128) = 0 THEN 1 END) AS dry_and_cloud_free
       FROM {observations}
       WHERE scene_id NOT IN (SELECT scene_id FROM {scenes} WHERE cloud_pct >= 90)
       GROUP BY sensor, yr""",
)
def p6(i):
    kept = masks.exclude(i.observations, i.scenes.where("cloud_pct >= 90"), "scene_id")
    flags = masks.mask_flags(F.col("qa"), ["cloud", "shadow", "water"])
    return kept.groupBy("sensor", "yr").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(flags["cloud"]).alias("cloud_free"),
        F.count_if(flags["shadow"]).alias("shadow_free"),
        F.count_if(flags["cloud"] & flags["water"]).alias("dry_and_cloud_free"),
    )


@query(
    "p7_rescale",
    f"""SELECT scene_id, yi, xi, {s6('b4 * 1e6 / 10000e0')} AS tenth,
               {s6('b4 * 1e6 * 0.0000275e0 - 0.2e0')} AS reflectance FROM {{observations}}""",
)
def p7(i):
    stored = F.col("b4") * 1e6
    return i.observations.select(
        "scene_id", "yi", "xi", r6(stored / 10000.0).alias("tenth"),
        r6(indices.surface_reflectance(stored)).alias("reflectance"),
    )


@query("p8_cloud_threshold", "SELECT img, yi, xi, prob > 65 AS is_cloud FROM {rasters}")
def p8(i):
    return i.rasters.select("img", "yi", "xi", masks.cloud_flag(F.col("prob")).alias("is_cloud"))


@query("p9_dark_pixels", "SELECT img, yi, xi, nir < 2000e0 AND scl <> 6 AS is_dark FROM {rasters}")
def p9(i):
    return i.rasters.select(
        "img", "yi", "xi", masks.dark_flag(F.col("nir"), F.col("scl")).alias("is_dark")
    )


SHADOWS = """
ray AS (SELECT DISTINCT img, yi + CAST(round(-k * sin(radians(90 - sun_azimuth))) AS INT) AS yi,
               xi + CAST(round(k * cos(radians(90 - sun_azimuth))) AS INT) AS xi
        FROM {rasters}, generate_series(0, 15) g(k) WHERE prob > 65),
flags AS (SELECT r.*, prob > 65 AS is_cloud,
                 ray.img IS NOT NULL AND nir < 2000e0 AND scl <> 6 AS is_shadow
          FROM {rasters} r LEFT JOIN ray ON ray.img = r.img AND ray.yi = r.yi AND ray.xi = r.xi),
er AS (SELECT a.img, a.yi, a.xi, min(CASE WHEN b.is_cloud OR b.is_shadow THEN 1 ELSE 0 END) AS m
       FROM flags a JOIN flags b ON a.img = b.img AND (a.yi - b.yi) * (a.yi - b.yi) + (a.xi - b.xi) * (a.xi - b.xi) <= 4
       GROUP BY a.img, a.yi, a.xi),
masked AS (SELECT a.img, a.yi, a.xi, CAST(max(b.m) AS INT) AS mask
       FROM er a JOIN er b ON a.img = b.img AND (a.yi - b.yi) * (a.yi - b.yi) + (a.xi - b.xi) * (a.xi - b.xi) <= 25
       GROUP BY a.img, a.yi, a.xi)"""


@query("p10_shadow_projection", "SELECT img, yi, xi, is_cloud, is_shadow FROM flags", SHADOWS)
def p10(i):
    flagged = i.rasters.withColumn("is_cloud", masks.cloud_flag(F.col("prob"))).withColumn(
        "is_dark", masks.dark_flag(F.col("nir"), F.col("scl"))
    )
    return masks.cast_shadows(flagged, ["img"], "sun_azimuth").select(
        "img", "yi", "xi", "is_cloud", "is_shadow"
    )


@query(
    "p11_focal_opening",
    "SELECT img, yi, xi, mask FROM m2",
    """
bin AS (SELECT img, yi, xi, CASE WHEN prob > 20 THEN 1 ELSE 0 END AS v FROM {rasters}),
m1 AS (SELECT a.img, a.yi, a.xi, min(b.v) AS v FROM bin a JOIN bin b ON a.img = b.img
         AND (a.yi - b.yi) * (a.yi - b.yi) + (a.xi - b.xi) * (a.xi - b.xi) <= 4 GROUP BY 1, 2, 3),
m2 AS (SELECT a.img, a.yi, a.xi, max(b.v) AS mask FROM m1 a JOIN m1 b ON a.img = b.img
         AND (a.yi - b.yi) * (a.yi - b.yi) + (a.xi - b.xi) * (a.xi - b.xi) <= 25 GROUP BY 1, 2, 3)""",
)
def p11(i):
    # a low threshold, so that some patch survives the shrinking; small tiles to cross borders
    flagged = i.rasters.select(
        "img", "yi", "xi", (F.col("prob") > 20).cast("int").alias("flag")
    )
    return masks.clean_mask(flagged, ["img"], "flag", tile=8).select("img", "yi", "xi", "mask")


@query(
    "p12_apply_mask",
    """SELECT r.img, r.yi, r.xi, CASE WHEN mask = 0 THEN nir END AS "B8",
              CASE WHEN mask = 0 THEN soft END AS "B4"
       FROM {rasters} r JOIN masked m ON m.img = r.img AND m.yi = r.yi AND m.xi = r.xi""",
    SHADOWS,
)
def p12(i):
    masked = masks.cloud_shadow_mask(i.rasters, ["img"], tile=16)
    named = masked.withColumn("B8", F.col("nir")).withColumn("B4", F.col("soft"))
    blank = masks.null_masked(named, ["B8", "B4"], F.col("mask") == 0)
    return masks.band_columns(blank, r"B\d+|img|yi|xi")


@query(
    "p13_nan_fill",
    f"""SELECT scene_id, yi, xi, CASE WHEN qa % 7 = 0 THEN -1e0 ELSE {s6('b4')} END AS inpt,
               CASE WHEN qa % 5 = 0 THEN 0e0 ELSE {s6('b5')} END AS target FROM {{observations}}""",
)
def p13(i):
    nan = F.lit(float("nan"))
    raw = i.observations.select(
        "scene_id", "yi", "xi",
        F.when(F.col("qa") % 7 == 0, nan).otherwise(F.col("b4")).alias("inpt"),
        F.when(F.col("qa") % 5 == 0, nan).otherwise(F.col("b5")).alias("target"),
    )
    clean = cubes.ingest(raw, ["inpt", "target"])
    return rounded(clean.fillna({"inpt": -1.0, "target": 0.0}), "inpt", "target")


@query(
    "p14_positional_select",
    f"SELECT yi, xi, t, {s6('b2')} AS b2, {s6('b5')} AS b5 FROM {{cube}} WHERE t IN (2, 4)",
)
def p14(i):
    bands = [BANDS[k] for k in (1, 4)]
    return rounded(i.cube.where(F.col("t").isin(2, 4)).select("yi", "xi", "t", *bands), *bands)


@query(
    "p15_class_filter",
    """SELECT fid, label FROM {features} WHERE label IN (
         SELECT label FROM (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS k FROM {features})
         WHERE k IN (0, 2))""",
)
def p15(i):
    return class_filter(i.features, "label", [0, 2]).select("fid", "label")


YEARS = list(range(1995, 2002))


@query(
    "p16_period_band_names",
    "SELECT yi, xi, "
    + ", ".join(
        f'{s6(f"max(CASE WHEN yr = {y} THEN {b} END)")} AS "{y}_{b}"' for y in YEARS for b in ("b1", "b4")
    )
    + " FROM {cube} GROUP BY yi, xi",
)
def p16(i):
    wide = composites.stack_periods(i.cube, ["yi", "xi"], "yr", YEARS, ["b1", "b4"])
    return rounded(wide, *[c for c in wide.columns if c not in ("yi", "xi")])


@query(
    "p16_month_band_names",
    f"""SELECT yi, xi, concat_ws('_', yr, month(acquired), k.b) AS name,
               {s6("median(CASE k.b WHEN 'b4' THEN b4 ELSE b5 END)")} AS value
        FROM {{observations}}, (VALUES ('b4'), ('b5')) k(b) GROUP BY 1, 2, 3""",
)
def p16b(i):
    monthly = i.observations.withColumn("month", F.month("acquired"))
    out = composites.median_composite(monthly, ["yi", "xi", "yr", "month"], ["b4", "b5"])
    return rounded(composites.long_names(out, ["yi", "xi"], ["yr", "month"], ["b4", "b5"]), "value")


@query("p17_cast_on_write", "SELECT scene_id, yi, xi, CAST(b1 AS FLOAT) AS b1 FROM {observations}")
def p17(i):
    return cubes.as_float(i.observations.select("scene_id", "yi", "xi", "b1"), ["b1"])


@query(
    "p18_row_validity",
    f"""SELECT yi, xi, t, {s6('(b1 - b2) / (b1 + b2)')} AS nd, {s6('b5')} AS b5 FROM {{cube}}
        WHERE b1 + b2 <> 0""",
)
def p18(i):
    derived = i.cube.withColumn("nd", indices.normalised_difference(F.col("b1"), F.col("b2")))
    return rounded(pairs.drop_invalid(derived, ["nd"]).select("yi", "xi", "t", "nd", "b5"), "nd", "b5")


@query(
    "p19_alignment_check",
    """SELECT coalesce(a.yi, b.yi) AS yi, coalesce(a.sensor, b.sensor) AS sensor, a.n AS left_value, b.n AS right_value
       FROM (SELECT yi, sensor, count(*) AS n FROM {observations} GROUP BY 1, 2) a
       FULL JOIN (SELECT yi, sensor, count(*) AS n FROM {observations} WHERE qa <> 50 GROUP BY 1, 2) b
         ON a.yi = b.yi AND a.sensor = b.sensor WHERE a.n IS DISTINCT FROM b.n""",
)
def p19(i):
    count = F.count(F.lit(1)).alias("n")
    full = i.observations.groupBy("yi", "sensor").agg(count)
    part = i.observations.where("qa <> 50").groupBy("yi", "sensor").agg(count)
    return pairs.misaligned(full, part, ["yi", "sensor"], "n")


@query(
    "p20_drop_leading_token",
    f"""SELECT vec_id, CAST(64 AS INT) AS n, {s6('list_sum(CAST(emb_a AS DOUBLE[]))')} AS total
        FROM {{embedding_pairs}}""",
)
def p20(i):
    a = F.col("emb_a")
    # every third vector carries one more element in front
    carried = F.when(F.col("vec_id") % 3 == 0, F.concat(F.slice("emb_b", 1, 1), a)).otherwise(a)
    trimmed = vectors.drop_leading_token(carried, 64)
    return i.embedding_pairs.select("vec_id", trimmed.alias("v")).select(
        "vec_id", F.size("v").alias("n"), r6(vectors.total(F.col("v"))).alias("total")
    )

"""Grid and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.base import (
    BURN, CHUNK, CHUNKS, EXTENT, G, HITS, MAXY, SCALE, WIDTH, query, r6, rounded, s6,
)
from gridloom.functions import rings
from gridloom.operators import grid, patches, polygons
from gridloom.operators.ranks import lookup_join
from gridloom.plans import landcover


def chunks_of(i):
    return grid.chunk_grid(i.extent, G, G)


def skeleton(i):
    """Every pixel of the chunks that some polygon meets."""
    kept = polygons.filter_chunks(chunks_of(i), i.polygons, i.extent, G, G)
    return grid.chunk_pixels(kept.select("chunk_id", "r", "c"), CHUNK, CHUNK).drop("r", "c")


@query("g1_chunk_grid", "SELECT chunk_id, r, c, ty, tx FROM chunks", CHUNKS)
def g1(i):
    return chunks_of(i)


@query(
    "g2_pixel_coordinates",
    """
SELECT 'lat' AS axis, CAST(k AS INT) AS idx, maxy - 30e0 * k AS coord FROM ext,
  generate_series(0, CAST(floor((maxy - miny + 120e0 - (maxy - miny) % 120e0) / 30e0) AS INT) - 1) g(k)
UNION ALL
SELECT 'lon', CAST(k AS INT), minx + 30e0 * k FROM ext,
  generate_series(0, CAST(floor((maxx - minx + 120e0 - (maxx - minx) % 120e0) / 30e0) AS INT) - 1) g(k)""",
    EXTENT,
)
def g2(i):
    return grid.coordinate_axes(i.extent, G, G, SCALE)


@query("g3_chunk_filter", "SELECT DISTINCT chunk_id, ty, tx FROM hits", HITS)
def g3(i):
    return polygons.filter_chunks(chunks_of(i), i.polygons, i.extent, G, G).select(
        "chunk_id", "ty", "tx"
    )


@query(
    "g4_total_bounds",
    f"""SELECT {s6('min(x0)')} AS minx, {s6('min(y0)')} AS miny, {s6('max(x0 + w)')} AS maxx,
        {s6('max(y0 + h)')} AS maxy FROM {{features}}""",
)
def g4(i):
    return rounded(grid.total_bounds(i.polygons), "minx", "miny", "maxx", "maxy")


@query(
    "g6_label_subset",
    f"""SELECT yi, xi, t, {s6('b1')} AS b1 FROM {{cube}}
        WHERE lat BETWEEN 840e0 AND 1140e0 AND lon BETWEEN 150e0 AND 900e0""",
)
def g6(i):
    part = grid.subset_by_labels(i.cube, 150.0, 840.0, 900.0, 1140.0)
    return rounded(part.select("yi", "xi", "t", "b1"), "b1")


@query(
    "g7_rasterise",
    """
SELECT p.yi, p.xi, CASE WHEN b.yi IS NULL THEN 0e0 ELSE 1e0 END AS burn
FROM (SELECT DISTINCT CAST(r * 4 + dy AS INT) AS yi, CAST(c * 4 + dx AS INT) AS xi
      FROM hits, generate_series(0, 3) a(dy), generate_series(0, 3) b(dx)) p
LEFT JOIN (SELECT DISTINCT yi, xi FROM burn) b ON b.yi = p.yi AND b.xi = p.xi""",
    HITS + "," + BURN,
)
def g7(i):
    return polygons.rasterise(
        skeleton(i).select("yi", "xi"), i.polygons, 0.0, MAXY, SCALE, tile=16
    )


@query(
    "g8_label_cube",
    """
SELECT p.chunk_id, p.yi, p.xi, l.band, d.t, CASE WHEN b.yi IS NULL THEN 0e0 ELSE 1e0 END AS value
FROM (SELECT DISTINCT chunk_id, CAST(r * 4 + dy AS INT) AS yi, CAST(c * 4 + dx AS INT) AS xi
      FROM hits, generate_series(0, 3) a(dy), generate_series(0, 3) b(dx)) p
CROSS JOIN lab l CROSS JOIN dat d
LEFT JOIN (SELECT DISTINCT label, yr, yi, xi FROM burn) b
  ON b.yi = p.yi AND b.xi = p.xi AND b.label = l.label AND b.yr = d.yr""",
    HITS + "," + BURN + """,
lab AS (SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS band
        FROM (SELECT DISTINCT label FROM {features})),
dat AS (SELECT yr, CAST(row_number() OVER (ORDER BY yr) - 1 AS INT) AS t
        FROM (SELECT DISTINCT yr FROM {features}))""",
)
def g8(i):
    return landcover.annotate(i.polygons, i.extent, 0.0, MAXY, CHUNK, SCALE, "label", "yr")


@query("g9_polygon_area", f"SELECT fid, {s6('w * h / 2e0')} AS area FROM {{features}}")
def g9(i):
    return i.polygons.select("fid", r6(rings.area(F.col("ring"))).alias("area"))


@query(
    "g10_utm_zone",
    """
SELECT o_orderkey, CASE WHEN lat > 0 THEN 'EPSG:326' ELSE 'EPSG:327' END || lpad(CAST(CASE
    WHEN lat >= 56 AND lat < 64 AND lon >= 3 AND lon < 12 THEN 32
    WHEN lat >= 72 AND lat <= 84 AND lon >= 0 AND lon < 9 THEN 31
    WHEN lat >= 72 AND lat <= 84 AND lon >= 9 AND lon < 21 THEN 33
    WHEN lat >= 72 AND lat <= 84 AND lon >= 21 AND lon < 33 THEN 35
    WHEN lat >= 72 AND lat <= 84 AND lon >= 33 AND lon < 42 THEN 37
    ELSE CAST(floor((lon + 180e0) / 6e0) AS INT) % 60 + 1 END AS VARCHAR), 2, '0') AS epsg
FROM (SELECT o_orderkey, (o_orderkey * 7) % 3600 / 10e0 - 180e0 AS lon,
             (o_custkey * 11) % 1640 / 10e0 - 80e0 AS lat FROM {orders})""",
)
def g10(i):
    lon = (F.col("o_orderkey") * 7) % 3600 / 10.0 - 180.0
    lat = (F.col("o_custkey") * 11) % 1640 / 10.0 - 80.0
    return i.orders.select("o_orderkey", rings.utm_epsg(lon, lat).alias("epsg"))


@query(
    "g11_centre_clip",
    """
SELECT img, CAST(yi - y0 AS INT) AS yi, CAST(xi - 14 AS INT) AS xi, pred
FROM (SELECT r.*, CAST(floor((h - 11) / 2e0) AS INT) AS y0 FROM {rasters} r
      JOIN (SELECT img, max(yi) + 1 AS h FROM {rasters} GROUP BY img) s USING (img))
WHERE yi >= y0 AND yi < y0 + 11 AND xi >= 14 AND xi < 14 + 11""",
)
def g11(i):
    heights = i.rasters.groupBy("img").agg((F.max("yi") + 1).alias("h_"))
    images = lookup_join(i.rasters, heights, ["img"])
    return grid.centre_clip(images, F.col("h_"), WIDTH, 11).select("img", "yi", "xi", "pred")


@query(
    "g12_centre_pad",
    """
SELECT m.img, CAST(y AS INT) AS yi, CAST(x AS INT) AS xi, coalesce(r.pred, -1e0) AS pred
FROM (SELECT DISTINCT img FROM {rasters}) m
CROSS JOIN generate_series(0, 48) a(y) CROSS JOIN generate_series(0, 48) b(x)
LEFT JOIN {rasters} r ON r.img = m.img AND r.yi + 16 = y AND r.xi + 4 = x""",
)
def g12(i):
    images = i.rasters.select("img").distinct()
    data = i.rasters.select("img", "yi", "xi", "pred")
    return grid.centre_pad(images, data, ["img"], 16, WIDTH, 49, {"pred": -1.0})


@query(
    "g13_nearest_cell",
    """
SELECT fid, CAST(least(greatest(ceil((e.maxy - cy) / 30e0 - 0.5e0), 0), (e.maxy - e.miny) / 30e0 - 1) AS INT) AS yi,
       CAST(least(greatest(ceil((cx - e.minx) / 30e0 - 0.5e0), 0), (e.maxx - e.minx) / 30e0 - 1) AS INT) AS xi
FROM (SELECT fid, x0 + w / 3e0 AS cx, y0 + h / 3e0 AS cy FROM {features}), ext e""",
    EXTENT,
)
def g13(i):
    labels = grid.pixel_extent(i.observations)
    c = rings.centroid(F.col("ring"))
    return grid.nearest_cell(i.polygons, c["x"], c["y"], labels, SCALE).select("fid", "yi", "xi")


@query(
    "g14_patch_around_point",
    f"""
SELECT fid, t, count(*) AS pixels, CAST(min(oy) AS INT) AS top, CAST(max(ox) AS INT) AS rightmost,
       {s6('avg(b1)')} AS b1
FROM (SELECT fid, CAST(round((1200e0 - y0) / 30e0) AS INT) AS cy, CAST(round(x0 / 30e0) AS INT) AS cx
      FROM {{features}}),
     generate_series(-1, 1) a(oy), generate_series(-1, 1) b(ox), {{cube}} c
WHERE c.yi = cy + oy AND c.xi = cx + ox GROUP BY fid, t""",
)
def g14(i):
    centres = i.features.select(
        "fid",
        F.round((MAXY - F.col("y0")) / SCALE).cast("int").alias("yi"),
        F.round(F.col("x0") / SCALE).cast("int").alias("xi"),
    )
    found = grid.patches_around(centres, i.cube, 3)
    return found.groupBy("fid", "t").agg(
        F.count(F.lit(1)).alias("pixels"), F.min("oy").alias("top"),
        F.max("ox").alias("rightmost"), r6(F.avg("b1")).alias("b1"),
    )


AOI = {"minx": 150.0, "miny": 450.0, "maxx": 750.0, "maxy": 900.0}


@query(
    "g15_intersect_fraction",
    f"""
SELECT scene_id, {s6('greatest(0e0, least(maxx, 750e0) - greatest(minx, 150e0)) * greatest(0e0, least(maxy, 900e0) - greatest(miny, 450e0)) / 270000e0')}
       AS fraction FROM {{scenes}}""",
)
def g15(i):
    return rounded(polygons.scene_fraction(i.scenes, AOI).select("scene_id", "fraction"), "fraction")


@query(
    "g16_patchify",
    """SELECT img, yi, xi, CAST(yi // 5 AS INT) AS pr, CAST(xi // 5 AS INT) AS pc,
              CAST(yi % 5 AS INT) AS oy, CAST(xi % 5 AS INT) AS ox, pred FROM {rasters}""",
)
def g16(i):
    return patches.patchify(i.rasters.select("img", "yi", "xi", "pred"), 5)


OVERLAP = """
win AS (
  SELECT r.img, r.yi, r.xi, r.soft, CAST(pr AS INT) AS pr, CAST(pc AS INT) AS pc,
         CAST(r.yi - pr * 3 AS INT) AS oy, CAST(r.xi - pc * 3 AS INT) AS ox
  FROM {rasters} r, generate_series(0, 3) a(pr), generate_series(0, 11) b(pc)
  WHERE r.yi - pr * 3 BETWEEN 0 AND 4 AND r.xi - pc * 3 BETWEEN 0 AND 4)"""


def windows_of(i):
    images = i.rasters.select("img", "yi", "xi", "soft")
    return patches.overlapping_patchify(images, 16, WIDTH, 5, 3)


@query("g17_overlapping_patchify", "SELECT img, yi, xi, soft, pr, pc, oy, ox FROM win", OVERLAP)
def g17(i):
    return windows_of(i)


@query(
    "g18_fold_mosaic",
    f"""SELECT img, CAST(pr * 3 + oy AS INT) AS yi, CAST(pc * 3 + ox AS INT) AS xi,
               {s6('avg(soft * (1 + pr))')} AS v, count(*) AS n
        FROM win GROUP BY 1, 2, 3""",
    OVERLAP,
)
def g18(i):
    scored = windows_of(i).drop("yi", "xi").withColumn("v", F.col("soft") * (1 + F.col("pr")))
    return rounded(patches.fold(scored, ["img"], ["v"], 3, "n"), "v")


@query(
    "g19_centre_crop",
    """SELECT img, CAST(yi - 2 AS INT) AS yi, CAST(xi - 14 AS INT) AS xi, soft FROM {rasters}
       WHERE yi BETWEEN 2 AND 12 AND xi BETWEEN 14 AND 24""",
)
def g19(i):
    return grid.centre_crop(i.rasters.select("img", "yi", "xi", "soft"), 16, WIDTH, 11)


@query(
    "g20_grid_affine",
    """SELECT fid, w / 8e0 AS sx, h / 4e0 AS sy, x0 + 3 * (w / 8e0) AS lon3, y0 + h - 2 * (h / 4e0) AS lat2,
              CAST(floor((x0 - 0e0) / 30e0) AS INT) AS xi, CAST(floor((1200e0 - (y0 + h)) / 30e0) AS INT) AS yi
       FROM (SELECT fid, x0, y0, w, h FROM {features})""",
)
def g20(i):
    # corners as exact sums so that the affine divides the same numbers in both engines
    boxes = i.features.select(
        "fid", F.col("x0").alias("lon"), (F.col("y0") + F.col("h")).alias("lat"),
        F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"),
        F.col("w").alias("maxx"), F.col("h").alias("maxy"),
    )
    sized = grid.box_affine(boxes, 4, 8)
    indexed = grid.to_indices(sized, 0.0, MAXY, SCALE, SCALE)
    return indexed.select(
        "fid", "sx", "sy",
        (F.col("lon") + 3 * F.col("sx")).alias("lon3"),
        (F.col("lat") - 2 * F.col("sy")).alias("lat2"),
        "xi", "yi",
    )


@query(
    "g21_thin_coordinates",
    f"""SELECT CAST(yi // 2 AS INT) AS yi, CAST(xi // 3 AS INT) AS xi, t, {s6('b2')} AS b2
        FROM {{cube}} WHERE yi % 2 = 0 AND xi % 3 = 0""",
)
def g21(i):
    return rounded(grid.thin(i.cube.select("yi", "xi", "t", "b2"), 2, 3), "b2")


# windows of 4 x 4 pixels, shifted half a window up and left so that they leave the data
SHIFTED = CHUNKS + """,
lab AS (SELECT min(lon) AS minx, min(lat) AS miny, max(lon) AS maxx, max(lat) AS maxy FROM {observations}),
w0 AS (SELECT chunk_id AS sample_id, ty + 60e0 AS tY, tx - 60e0 AS tx FROM chunks),
w1 AS (SELECT w0.*, least(tY, maxy) AS ymax, greatest(tY - 90e0, miny) AS ymin,
              greatest(tx, minx) AS xmin, least(tx + 90e0, maxx) AS xmax, lab.minx, lab.maxy FROM w0, lab),
w2 AS (SELECT *, 4 - CAST((ymax - ymin) / 30e0 + 1 AS INT) AS yd, 4 - CAST((xmax - xmin) / 30e0 + 1 AS INT) AS xd FROM w1),
pads AS (SELECT sample_id, tY, tx,
   CAST(CASE WHEN ymax = maxy THEN yd ELSE 0 END AS INT) AS pad_top,
   CAST(CASE WHEN ymax = maxy THEN 0 ELSE yd END AS INT) AS pad_bottom,
   CAST(CASE WHEN xmin = minx THEN xd ELSE 0 END AS INT) AS pad_left,
   CAST(CASE WHEN xmin = minx THEN 0 ELSE xd END AS INT) AS pad_right,
   CAST((maxy - ymax) / 30e0 AS INT) AS row0, CAST((xmin - minx) / 30e0 AS INT) AS col0 FROM w2)"""


def shifted_windows(i):
    windows = chunks_of(i).select(
        F.col("chunk_id").alias("sample_id"), (F.col("ty") + 60.0).alias("tY"),
        (F.col("tx") - 60.0).alias("tx"),
    )
    return grid.window_pads(windows, grid.pixel_extent(i.observations), CHUNK, CHUNK, SCALE)


def padded_blocks(i):
    """Every shifted window at every time step, padded to full size."""
    windows = shifted_windows(i).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(6))))
    cube = i.cube.select("yi", "xi", "t", "b1")
    return grid.padded_windows(windows, cube, CHUNK, CHUNK, {"b1": -1.0})


@query(
    "g22_edge_padding",
    f"""
SELECT sample_id, CAST(s AS INT) AS t, pad_top, pad_bottom, pad_left, pad_right, CAST(y AS INT) AS oy,
       CAST(x AS INT) AS ox, coalesce({s6('c.b1')}, -1e0) AS b1
FROM pads p CROSS JOIN generate_series(0, 6) d(s) CROSS JOIN generate_series(0, 3) a(y) CROSS JOIN generate_series(0, 3) b(x)
LEFT JOIN {{cube}} c ON c.t = s
  AND y >= pad_top AND y < 4 - pad_bottom AND c.yi = row0 + y - pad_top
  AND x >= pad_left AND x < 4 - pad_right AND c.xi = col0 + x - pad_left""",
    SHIFTED,
)
def g22(i):
    pads = ["pad_top", "pad_bottom", "pad_left", "pad_right"]
    return rounded(padded_blocks(i).select("sample_id", "t", *pads, "oy", "ox", "b1"), "b1")


@query(
    "g23_unpad_write_back",
    """
SELECT sample_id, CAST(s AS INT) AS t, tY - 30e0 * pad_top AS tY, tx + 30e0 * pad_left AS tx,
       CAST(y - pad_top AS INT) AS oy, CAST(x - pad_left AS INT) AS ox
FROM pads, generate_series(0, 6) d(s), generate_series(0, 3) a(y), generate_series(0, 3) b(x)
WHERE y >= pad_top AND y < 4 - pad_bottom AND x >= pad_left AND x < 4 - pad_right""",
    SHIFTED,
)
def g23(i):
    return grid.unpad(padded_blocks(i), CHUNK, CHUNK, SCALE).select(
        "sample_id", "t", "tY", "tx", "oy", "ox"
    )


@query(
    "g24_flatten_pixels",
    f"""
SELECT p.yi, p.xi, CAST(b * 7 + s AS INT) AS pos, {s6("CASE b WHEN 0 THEN c.b3 ELSE c.b4 END")} AS value
FROM (SELECT DISTINCT yi, xi FROM {{cube}}) p
CROSS JOIN generate_series(0, 1) a(b) CROSS JOIN generate_series(0, 6) d(s)
LEFT JOIN {{cube}} c ON c.yi = p.yi AND c.xi = p.xi AND c.t = s""",
)
def g24(i):
    flat = patches.flatten_pixels(i.cube, ["yi", "xi"], ["b3", "b4"], "t", 7)
    return flat.select("yi", "xi", F.posexplode("features").alias("pos", "value")).withColumn(
        "value", r6("value")
    )


@query(
    "s6_region_index",
    """SELECT fid, CAST(ceil((1200e0 - (y0 + h)) / 30e0) AS INT) AS row0,
              CAST(ceil((x0 - 0e0) / 30e0) AS INT) AS col0 FROM {features}""",
)
def s6_(i):
    corners = i.features.select("fid", (F.col("y0") + F.col("h")).alias("ty"), F.col("x0").alias("tx"))
    return grid.region_index(corners, MAXY, 0.0, SCALE).select("fid", "row0", "col0")


@query(
    "s4_dense_skeleton",
    f"""
SELECT chunk_id, CAST(r * 4 + dy AS INT) AS yi, CAST(c * 4 + dx AS INT) AS xi, CAST(s AS INT) AS t,
       coalesce({s6('u.b1')}, -9999e0) AS b1, u.b2 IS NULL AS empty
FROM chunks k CROSS JOIN generate_series(0, 3) a(dy) CROSS JOIN generate_series(0, 3) b(dx)
CROSS JOIN generate_series(0, 6) d(s)
LEFT JOIN {{cube}} u ON u.yi = r * 4 + dy AND u.xi = c * 4 + dx AND u.t = s""",
    CHUNKS,
)
def s4(i):
    frame = grid.chunk_pixels(chunks_of(i).select("chunk_id", "r", "c"), CHUNK, CHUNK).drop("r", "c")
    frame = grid.with_axis(frame, F.sequence(F.lit(0), F.lit(6)), "t")
    data = i.cube.select("yi", "xi", "t", "b1", "b2")
    out = grid.densify(frame, data, ["yi", "xi", "t"], {"b1": -9999.0, "b2": None})
    return out.select(
        "chunk_id", "yi", "xi", "t", r6("b1").alias("b1"), F.col("b2").isNull().alias("empty")
    )


@query(
    "s7_struct_unpack",
    """
SELECT img, yi, xi, CAST(p // 3 AS INT) AS t, CAST(p % 3 AS INT) AS band,
       CASE p WHEN 0 THEN prob WHEN 1 THEN nir WHEN 2 THEN soft WHEN 3 THEN pred WHEN 4 THEN target
              ELSE sun_azimuth END AS value
FROM {rasters}, generate_series(0, 5) g(p)""",
)
def s7(i):
    fields = F.array("prob", "nir", "soft", "pred", "target", "sun_azimuth").alias("fields")
    return patches.unpack_fields(i.rasters.select("img", "yi", "xi", fields), "fields", 3)

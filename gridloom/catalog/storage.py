"""Source, sink and export queries.  Those that store a table read it back from the shared folder."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T

from gridloom.catalog.base import BANDS, CHUNK, HITS, SCALE, query, r6, rounded, s6
from gridloom.functions import indices, rings, vectors
from gridloom.operators import patches, polygons
from gridloom.plans import landcover
from gridloom.session import balance, scratch_path
from gridloom.sources import cubes, features as layers


@query(
    "s1_vector_scan",
    f"""SELECT fid, label, yr, CAST(4 AS INT) AS vertices, {s6('x0')} AS minx, {s6('y0')} AS miny,
               {s6('x0 + w')} AS maxx, {s6('y0 + h')} AS maxy FROM {{features}}""",
)
def s1(i):
    # each polygon as GeoJSON text, parsed back to a ring
    point = lambda x, y: F.format_string("[%.6f,%.6f]", x, y)
    x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
    corners = [point(x0, y0), point(x0 + w, y0), point(x0, y0 + h), point(x0, y0)]
    text = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *corners), F.lit("]]}"))
    ring = i.features.select("fid", "label", "yr", layers.ring_from_geojson(text).alias("ring"))
    boxed = polygons.with_geometry(ring).select(
        "fid", "label", "yr", F.size("ring").alias("vertices"), "minx", "miny", "maxx", "maxy"
    )
    return rounded(boxed, "minx", "miny", "maxx", "maxy")


@F.pandas_udf(T.BinaryType())
def _as_wkb(xs: pd.Series, ys: pd.Series) -> pd.Series:
    """Little-endian polygons of one ring."""
    def one(x, y):
        points = np.column_stack([x, y]).astype("<f8").tobytes()
        return struct.pack("<BIII", 1, 3, 1, len(x)) + points

    return pd.Series([one(x, y) for x, y in zip(xs, ys)])


@query(
    "s1_layer_files",
    f"""SELECT k.kind, fid, label, yr, CAST(4 AS INT) AS vertices, {s6('x0')} AS minx, {s6('y0')} AS miny,
               {s6('x0 + w')} AS maxx, {s6('y0 + h')} AS maxy
        FROM {{features}}, (VALUES ('ring'), ('geojson'), ('wkb')) k(kind)""",
)
def s1_files(i):
    """One layer written in three encodings of its geometry and read back from the files."""
    base = i.polygons.select("fid", "label", "yr", "ring")
    point = F.transform("ring", lambda p: F.format_string("[%.6f,%.6f]", p["x"], p["y"]))
    text = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.array_join(point, ","), F.lit("]]}"))
    encodings = {
        "ring": F.col("ring"), "geojson": text, "wkb": _as_wkb(F.col("ring")["x"], F.col("ring")["y"]),
    }
    out = None
    for kind, geometry in encodings.items():
        path = scratch_path(i.spark, f"layer-{kind}")
        base.select("fid", "label", "yr", geometry.alias("geometry")).write.parquet(path)
        layer = polygons.with_geometry(layers.read_features(i.spark, path, "geometry")).select(
            F.lit(kind).alias("kind"), "fid", "label", "yr", F.size("ring").alias("vertices"),
            "minx", "miny", "maxx", "maxy",
        )
        out = layer if out is None else out.unionByName(layer)
    return rounded(out, "minx", "miny", "maxx", "maxy")


@query(
    "s1_feature_collection",
    f"""SELECT fid, label, yr, CAST(4 AS INT) AS vertices, {s6('x0')} AS minx, {s6('y0')} AS miny,
               {s6('x0 + w')} AS maxx, {s6('y0 + h')} AS maxy FROM {{features}}""",
)
def s1_collection(i):
    """The layer as FeatureCollection files, read back line by line."""
    point = F.transform("ring", lambda p: F.format_string("[%.6f,%.6f]", p["x"], p["y"]))
    text = F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.array_join(point, ","), F.lit("]]}"))
    path = scratch_path(i.spark, "collection")
    # dealt out before they become text: a file of orders has few splits, and their texts are long
    dealt = balance(i.polygons.select("fid", "label", "yr", "ring"))
    layers.write_geojson(dealt.select("fid", "label", "yr", text.alias("geometry")), path, "geometry")
    kinds = i.features.select("fid", "label", "yr").schema.fields
    properties = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    layer = polygons.with_geometry(layers.read_geojson(i.spark, path, properties, by_line=True)).select(
        "fid", "label", "yr", F.size("ring").alias("vertices"), "minx", "miny", "maxx", "maxy"
    )
    return rounded(layer, "minx", "miny", "maxx", "maxy")


def write_cube(cube, path: str) -> None:
    stored = cubes.as_float(cube, BANDS).select("tile_id", "t", "yi", "xi", *BANDS)
    cubes.write_tiles(stored, path, tiles=cubes.tiles_per_folder(8 * 8))


def stored_cube(i) -> str:
    path = scratch_path(i.spark, "cube")
    write_cube(i.cube, path)
    return path


@query(
    "s2_cube_scan_optional_labels",
    f"""SELECT tile_id, t, count(*) AS n, {s6('sum(CAST(CAST(b5 AS FLOAT) AS DOUBLE))')} AS b5, count(*) AS unlabelled
        FROM {{cube}} GROUP BY tile_id, t""",
)
def s2(i):
    cube = cubes.read_cube(i.spark, stored_cube(i))
    labels = cubes.read_cube(i.spark, None)
    out = cubes.with_labels(cube, labels, ["yi", "xi"], "label")
    return out.groupBy("tile_id", "t").agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum(F.col("b5").cast("double"))).alias("b5"),
        F.count_if(F.col("label").isNull()).alias("unlabelled"),
    )


@query(
    "s5_region_write",
    f"""SELECT tile_id, t, yi, xi, CASE WHEN t = 2 THEN CAST(-1 AS FLOAT) ELSE CAST(b1 AS FLOAT) END AS b1 FROM {{cube}}""",
)
def s5(i):
    path = stored_cube(i)
    again = i.cube.where("t = 2").withColumn("b1", F.lit(-1.0))
    # writing the tiles of one step again replaces those tiles only, and is safe to repeat
    for _ in range(2):
        write_cube(again, path)
    return cubes.read_cube(i.spark, path).select("tile_id", "t", "yi", "xi", "b1")


@query(
    "s5_composite_to_tiles",
    """SELECT CAST(yi // 16 * 3 + xi // 16 AS INT) AS tile_id, yr, yi, xi, CAST(b1 AS FLOAT) AS b1, CAST(b4 AS FLOAT) AS b4 FROM {cube}""",
)
def s5b(i):
    path = scratch_path(i.spark, "composite")
    landcover.composite_tiles(i.observations, path, ["b1", "b4"], tile=16, across=3)
    return cubes.read_cube(i.spark, path).select("tile_id", "yr", "yi", "xi", "b1", "b4")


@query(
    "s8_stats_documents",
    f"""SELECT 'band' AS kind, band AS name, n, {s6('mean')} AS first_value, {s6('std')} AS second_value FROM b
        UNION ALL SELECT 'class', label, count(*), {s6('sum(w * h / 2e0)', 3)}, NULL FROM {{features}} GROUP BY label""",
    HITS + """,
inside AS (SELECT c.* FROM {cube} c JOIN (SELECT DISTINCT r, c AS cc FROM hits) k ON k.r = c.yi // 4 AND k.cc = c.xi // 4),
b AS (SELECT 'b1' AS band, count(b1) AS n, avg(b1) AS mean, stddev_samp(b1) AS std FROM inside
      UNION ALL SELECT 'b4', count(b4), avg(b4), stddev_samp(b4) FROM inside)""",
)
def s8b(i):
    tables = landcover.statistics_documents(
        i.cube, i.polygons, i.extent, CHUNK, SCALE, ["b1", "b4"], "label", rings.area(F.col("ring"))
    )
    path = scratch_path(i.spark, "documents")
    for name, table in tables.items():
        table.write.parquet(f"{path}/{name}")
    stored = {name: i.spark.read.parquet(f"{path}/{name}") for name in tables}
    bands = stored["bands"].select(
        F.lit("band").alias("kind"), F.col("band").alias("name"), "n",
        r6("mean").alias("first_value"), r6("std").alias("second_value"),
    )
    classes = stored["classes"].select(
        F.lit("class").alias("kind"), F.col("label").alias("name"), "n",
        r6("area", 3).alias("first_value"), F.lit(None).cast("double").alias("second_value"),
    )
    return bands.unionByName(classes)


@query(
    "s8_stats_merge",
    """SELECT coalesce(c.label, b.label, a.label) AS label, CAST(coalesce(c.n, b.n, a.n) AS BIGINT) AS n FROM
         (SELECT label, count(*) AS n FROM {features} WHERE label < '3' GROUP BY label) a
         FULL JOIN (SELECT label, sum(fid) AS n FROM {features} WHERE label > '2' AND label < '4' GROUP BY label) b
           ON a.label = b.label
         FULL JOIN (SELECT label, max(fid) AS n FROM {features} WHERE label >= '3' GROUP BY label) c
           ON c.label = coalesce(b.label, a.label)""",
)
def s8(i):
    by_label = lambda where, n: i.features.where(where).groupBy("label").agg(n.cast("long").alias("n"))
    path = scratch_path(i.spark, "stats")
    updates = [
        by_label("label < '3'", F.count(F.lit(1))),
        by_label("label > '2' AND label < '4'", F.sum("fid")),
        by_label("label >= '3'", F.max("fid")),
    ]
    for number, new in enumerate(updates):
        stored = cubes.update_document(i.spark, path, new, ["label"], ["n"], first=number == 0)
    return stored


@query(
    "s9_pixel_vectors",
    f"""SELECT yi || '_' || xi AS key, CAST(yi // 16 AS INT) AS ty, CAST(xi // 16 AS INT) AS tx, CAST(14 AS INT) AS dims,
               {s6('sum(b1) + sum(b4)')} AS total FROM {{cube}} GROUP BY yi, xi""",
)
def s9(i):
    path = scratch_path(i.spark, "vectors")
    rows = patches.flatten_pixels(i.cube, ["yi", "xi"], ["b1", "b4"], "t", 7)
    cubes.write_vectors(rows.withColumnRenamed("features", "vec"), path, tile=16)
    back = i.spark.read.parquet(path)
    present = F.filter("vec", lambda v: v.isNotNull())
    return back.select("key", "ty", "tx", F.size("vec").alias("dims"), r6(vectors.total(present)).alias("total"))


@query(
    "s10_georeferenced_export",
    """SELECT l_orderkey, l_linenumber, minx, maxy, sx, sy, CAST(l_discount AS FLOAT) AS value, 'EPSG:32610' AS crs
       FROM {lineitem} JOIN (SELECT row_number() OVER (ORDER BY fid DESC) - 1 AS position, x0 AS minx, y0 + h AS maxy, (x0 + w - x0) / 8 AS sx, (y0 + h - y0) / 4 AS sy
                             FROM {features}) f ON f.position = l_orderkey""",
)
def s10(i):
    """The number that leads a file's name is the place of its feature in the layer file."""
    named = i.lineitem.select(
        "l_orderkey", "l_linenumber", F.col("l_discount").cast("float").alias("value"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("_pred_t1.pt")).alias("file"),
    )
    layer = scratch_path(i.spark, "layer")
    i.features.orderBy(F.desc("fid")).write.parquet(layer)
    boxes = layers.with_positions(i.spark, layer).select(
        "position", F.col("x0").alias("minx"), F.col("y0").alias("miny"),
        (F.col("x0") + F.col("w")).alias("maxx"), (F.col("y0") + F.col("h")).alias("maxy"),
        F.lit("EPSG:32610").alias("crs"),
    )
    out = cubes.georeference(named, boxes, "position", "file", 4, 8)
    path = scratch_path(i.spark, "export")
    out.select("l_orderkey", "l_linenumber", "minx", "maxy", "sx", "sy", "value", "crs").write.partitionBy(
        "crs"
    ).parquet(path)
    return i.spark.read.parquet(path)


@query(
    "s11_band_groups",
    f"""SELECT yi, xi, 'rgb' AS grp, CAST(6 - t AS INT) AS t_label, {s6('b1')} AS c0, {s6('b2')} AS c1, {s6('b3')} AS c2 FROM {{cube}}
        UNION ALL SELECT yi, xi, 'ir', CAST(6 - t AS INT), {s6('b4')}, {s6('b5')}, {s6('b6')} FROM {{cube}}""",
)
def s11(i):
    return rounded(cubes.band_groups(i.cube, ["yi", "xi"], BANDS, 7), "c0", "c1", "c2")


@query(
    "s12_display_composites",
    f"""SELECT c.yi, c.xi, c.t, {s6('least(greatest((c.b3 - lo) / (hi - lo), 0e0), 1e0)')} AS red,
               {s6('c.b4')} AS false_red, {s6('n.b4 - c.b4')} AS next_change
        FROM (SELECT min(b3) AS lo, max(b3) AS hi FROM {{cube}}), {{cube}} c
        LEFT JOIN {{cube}} n ON n.yi = c.yi AND n.xi = c.xi AND n.t = c.t + 1""",
)
def s12(i):
    from gridloom.operators.temporal import first_difference

    shown = cubes.display_bands(i.cube, ["yi", "xi", "t"], BANDS)
    span = shown.agg(F.struct(F.min("red").alias("lo"), F.max("red").alias("hi"))).scalar()
    stretched = shown.withColumn("s_", span).withColumn(
        "red", indices.stretch(F.col("red"), F.col("s_.lo"), F.col("s_.hi"))
    )
    change = first_difference(shown, ["yi", "xi"], ["false_red"]).withColumnRenamed("false_red", "next_change")
    out = stretched.join(change, ["yi", "xi", "t"], "left")
    return rounded(out.select("yi", "xi", "t", "red", "false_red", "next_change"), "red", "false_red", "next_change")


@query(
    "s13_split_list",
    "SELECT split, count(*) AS n, min(t) AS first_t, max(tile_id) AS last_tile FROM {splits} GROUP BY split",
)
def s13(i):
    path = scratch_path(i.spark, "splits")
    i.splits.write.partitionBy("split").parquet(path)
    stored = i.spark.read.parquet(path)
    return stored.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"), F.max("tile_id").alias("last_tile")
    )

"""Rings, rasterising and joins against brute force."""

import json
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import rings
from gridloom.operators import grid, polygons
from gridloom.sources import features as layers

RING = "array<struct<x:double,y:double>>"


def star(rng, cx, cy, n, radius):
    """A simple, often concave polygon around a centre."""
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    points = [
        (cx + math.cos(a) * radius * rng.uniform(0.3, 1), cy + math.sin(a) * radius * rng.uniform(0.3, 1))
        for a in angles
    ]
    return points + points[:1]


def inside(ring, px, py):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > py) != (by > py) and px < ax + (py - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


def segment_meets_box(ax, ay, bx, by, box):
    """Clip a segment to a closed box."""
    minx, miny, maxx, maxy = box
    t0, t1 = 0.0, 1.0
    for p, q in ((ax - bx, ax - minx), (bx - ax, maxx - ax), (ay - by, ay - miny), (by - ay, maxy - ay)):
        if p == 0:
            if q < 0:
                return False
        elif p < 0:
            t0 = max(t0, q / p)
        else:
            t1 = min(t1, q / p)
    return t0 <= t1


def touches(ring, box):
    return inside(ring, box[0], box[1]) or any(
        segment_meets_box(*a, *b, box) for a, b in zip(ring, ring[1:])
    )


@pytest.fixture(scope="module")
def layer(spark):
    rng = random.Random(11)
    shapes = [star(rng, rng.uniform(0, 900), rng.uniform(0, 600), rng.randrange(4, 12), rng.uniform(10, 260))
              for _ in range(40)]
    rows = [(k, "abc"[k % 3], 2000 + k % 4, [tuple(p) for p in s]) for k, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, f"fid int, label string, yr int, ring {RING}")
    return polygons.with_geometry(df), shapes


def test_area_and_centroid(spark, layer):
    df, shapes = layer
    rows = df.select("fid", rings.area(F.col("ring")).alias("a"), rings.centroid(F.col("ring")).alias("c")).collect()
    for r in rows:
        x, y = np.array(shapes[r.fid]).T
        cross = x[:-1] * y[1:] - x[1:] * y[:-1]
        area = cross.sum() / 2
        assert r.a == pytest.approx(abs(area))
        assert r.c.x == pytest.approx(((x[:-1] + x[1:]) * cross).sum() / (6 * area))
        assert r.c.y == pytest.approx(((y[:-1] + y[1:]) * cross).sum() / (6 * area))


@pytest.mark.parametrize("tile", [4, 256])
def test_burned_pixels(spark, layer, tile):
    df, shapes = layer
    got = set(map(tuple, polygons.burned_pixels(df, 0.0, 600.0, 20.0, ["fid"], tile=tile, extent=(30, 45)).collect()))
    expected = {
        (k, yi, xi) for k, s in enumerate(shapes) for yi in range(30) for xi in range(45)
        if inside(s, (xi + 0.5) * 20, 600 - (yi + 0.5) * 20)
    }
    assert got == expected


def test_hole_is_not_burned(spark):
    square = lambda lo, hi: [(lo, lo), (hi, lo), (hi, hi), (lo, hi), (lo, lo)]
    df = spark.createDataFrame([([square(0.0, 100.0), square(30.0, 70.0)],)], f"rings array<{RING}>")
    df = df.select(
        F.lit(0.0).alias("minx"), F.lit(0.0).alias("miny"), F.lit(100.0).alias("maxx"),
        F.lit(100.0).alias("maxy"), rings.edges_of_rings(F.col("rings")).alias("edges"),
    )
    got = {(r.yi, r.xi) for r in polygons.burned_pixels(df, 0.0, 100.0, 10.0, []).collect()}
    assert len(got) == 100 - 16 and (4, 4) not in got and (0, 0) in got


def test_shared_edge_burns_once(spark):
    left = [(0.0, 0.0), (45.0, 0.0), (25.0, 100.0), (0.0, 100.0), (0.0, 0.0)]
    right = [(45.0, 0.0), (100.0, 0.0), (100.0, 100.0), (25.0, 100.0), (45.0, 0.0)]
    df = polygons.with_geometry(spark.createDataFrame([(0, left), (1, right)], f"fid int, ring {RING}"))
    pixels = [(r.yi, r.xi) for r in polygons.burned_pixels(df, 0.0, 100.0, 10.0, ["fid"]).collect()]
    assert len(pixels) == len(set(pixels)) == 100


def test_cells_meeting_polygons(spark, layer):
    df, shapes = layer
    cells = polygons.polygon_cells(df, F.lit(0.0), F.lit(600.0), 70.0, 90.0)
    got = {(r.fid, r.r, r.c) for r in cells.select("fid", "r", "c").collect()}
    expected = {
        (k, r, c) for k, s in enumerate(shapes) for r in range(-5, 15) for c in range(-5, 17)
        if touches(s, (c * 90, 600 - (r + 1) * 70, (c + 1) * 90, 600 - r * 70))
    }
    assert got == expected


def test_touching_box_counts(spark):
    square = [(0.0, 0.0), (30.0, 0.0), (30.0, 30.0), (0.0, 30.0), (0.0, 0.0)]
    df = polygons.with_geometry(spark.createDataFrame([(square,)], f"ring {RING}"))
    extent = spark.createDataFrame([(0.0, -30.0, 60.0, 30.0)], "minx double, miny double, maxx double, maxy double")
    chunks = grid.chunk_grid(extent, 30.0, 30.0)
    kept = {(r.ty, r.tx) for r in polygons.filter_chunks(chunks, df, extent, 30.0, 30.0).collect()}
    assert kept == {(30.0, 0.0), (30.0, 30.0), (0.0, 0.0), (0.0, 30.0)}


def test_polygon_around_a_cell(spark):
    big = [(-500.0, -500.0), (500.0, -500.0), (500.0, 500.0), (-500.0, 500.0), (-500.0, -500.0)]
    df = polygons.with_geometry(spark.createDataFrame([(big,)], f"ring {RING}"))
    cells = polygons.polygon_cells(df, F.lit(-600.0), F.lit(600.0), 100.0, 100.0)
    assert cells.count() == 12 * 12


def test_label_cube_with_many_planes(spark, layer):
    """More planes than one word of bits holds."""
    df, shapes = layer
    named = df.withColumn("label", F.concat(F.lit("c"), F.lpad(F.col("fid").cast("string"), 2, "0")))
    skeleton = spark.range(30 * 45).select(
        F.floor(F.col("id") / 45).cast("int").alias("yi"), (F.col("id") % 45).cast("int").alias("xi")
    )
    cube = polygons.label_cube(skeleton, named, 0.0, 600.0, 20.0, "label", "yr", tile=8)
    assert cube.count() == 30 * 45 * 40 * 4
    ones = {(r.band, r.t, r.yi, r.xi) for r in cube.where("value = 1").collect()}
    assert ones == {
        (k, k % 4, yi, xi) for k, s in enumerate(shapes) for yi in range(30) for xi in range(45)
        if inside(s, (xi + 0.5) * 20, 600 - (yi + 0.5) * 20)
    }


def test_empty_layer(spark, layer):
    df, _ = layer
    none = df.where(F.lit(False))
    extent = spark.createDataFrame([(0.0, 0.0, 90.0, 90.0)], "minx double, miny double, maxx double, maxy double")
    chunks = grid.chunk_grid(extent, 30.0, 30.0)
    assert chunks.count() == 9
    assert polygons.filter_chunks(chunks, none, extent, 30.0, 30.0).count() == 0
    assert polygons.burned_pixels(none, 0.0, 600.0, 20.0, ["label"]).count() == 0
    skeleton = spark.createDataFrame([(0, 0)], "yi int, xi int")
    assert polygons.label_cube(skeleton, none, 0.0, 600.0, 20.0, "label", "yr").count() == 0


def wkb(ring, order="<"):
    flag = 1 if order == "<" else 0
    body = bytes([flag]) + struct.pack(order + "III", 3, 1, len(ring))
    return body + b"".join(struct.pack(order + "dd", *p) for p in ring)


def test_readers_agree(spark, layer, tmp_path):
    _, shapes = layer
    plain = [[tuple(p) for p in s] for s in shapes]
    rows = [
        (k, wkb(s, "<" if k % 2 else ">"), json.dumps({"type": "Polygon", "coordinates": [s]}))
        for k, s in enumerate(plain)
    ]
    spark.createDataFrame(rows, "fid int, w binary, g string").write.parquet(str(tmp_path / "layer"))
    for geometry in ("w", "g"):
        got = {
            r.fid: [(p.x, p.y) for p in r.ring]
            for r in layers.read_features(spark, str(tmp_path / "layer"), geometry).collect()
        }
        assert got == dict(enumerate(plain))
    collection = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"fid": k, "label": "x"},
         "geometry": {"type": "Polygon", "coordinates": [s]}} for k, s in enumerate(plain)]}
    (tmp_path / "layer.json").write_text(json.dumps(collection))
    read = layers.read_geojson(spark, str(tmp_path / "layer.json"), "fid int, label string").collect()
    assert {r.fid: [(p.x, p.y) for p in r.ring] for r in read} == dict(enumerate(plain))
    assert {r.label for r in read} == {"x"}


def shape_of(k):
    return [(float(k), 0.0), (float(k), 2.0), (k + 1.0, 2.0), (float(k), 0.0)]


def test_a_large_collection_is_read_by_several_tasks(spark, tmp_path):
    rows = [(k, json.dumps({"type": "Polygon", "coordinates": [shape_of(k)]}),
             None if k % 5 == 0 else 'a "type": "Feature", b\n{') for k in range(3000)]
    rows.append((3000, None, "no shape"))
    layer = spark.createDataFrame(rows, "fid int, geometry string, label string")
    path = str(tmp_path / "one")
    layers.write_geojson(layer.coalesce(1), path, "geometry")
    (file,) = (tmp_path / "one").glob("part-*")
    assert len(json.loads(file.read_text())["features"]) == 3001
    spark.conf.set("spark.sql.files.maxPartitionBytes", 50_000)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        read = layers.read_geojson(spark, path, "fid int, label string", by_line=True)
        tasks = {r.p for r in read.select(F.spark_partition_id().alias("p")).distinct().collect()}
        got = {r.fid: r for r in read.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(tasks) > 3 and len(got) == 3001
    for k, _, label in rows:
        assert got[k].label == label
        assert got[k].ring is None if k == 3000 else [(p.x, p.y) for p in got[k].ring] == shape_of(k)
    whole = layers.read_geojson(spark, path, "fid int, label string")
    assert {r.fid: r.ring for r in whole.collect()} == {k: r.ring for k, r in got.items()}


def test_a_line_of_a_collection_is_parsed_once(spark, tmp_path):
    layer = spark.createDataFrame([(1, json.dumps({"type": "Polygon", "coordinates": [shape_of(1)]}))], "fid int, geometry string")
    path = str(tmp_path / "one")
    layers.write_geojson(layer, path, "geometry")
    read = layers.read_geojson(spark, path, "fid int", by_line=True)
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructField(properties") == 1
    assert [r.fid for r in read.collect()] == [1]


def test_cells_around_many_centres_are_not_broadcast(spark, tmp_path):
    # a table of little size by its file, of nine times the rows once its cells are named
    spark.range(2000).selectExpr("id AS fid", "CAST(id % 50 AS INT) AS yi", "CAST(id % 40 AS INT) AS xi").write.parquet(str(tmp_path / "c"))
    centres = spark.read.parquet(str(tmp_path / "c"))
    pixels = spark.range(2000).selectExpr("CAST(id % 50 AS INT) AS yi", "CAST(id DIV 50 AS INT) AS xi", "id AS v").repartition(4)
    found = grid.patches_around(centres, pixels, 3)
    rows = found.collect()
    # row 0 and 49, column 0 and 39 lack a side
    want = sum(1 for k in range(2000) for y in (-1, 0, 1) for x in (-1, 0, 1)
               if 0 <= k % 50 + y < 50 and 0 <= k % 40 + x < 40)
    assert len(rows) == want
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_features_in_any_layout_are_read_or_refused(spark, tmp_path):
    features = [{"properties": {"fid": k}, "geometry": {"type": "Polygon", "coordinates": [shape_of(k)]},
                 "type": "Feature"} for k in range(4)]
    one = [json.dumps(f) for f in features]
    head = '{\n"type": "FeatureCollection",\n"name": "x",\n"features": [\n'
    fine = {"lines": head + ",\n".join(one) + "\n]\n}\n", "crlf": head + " ,\r\n".join(one) + "\r\n] }",
            "two a line": head + ", ".join(one[:2]) + ",\n" + ", ".join(one[2:]) + "\n]}"}
    collection = {"type": "FeatureCollection", "features": features}
    refused = {"one line": json.dumps(collection), "pretty": json.dumps(collection, indent=1),
               "cut": head + one[0] + ',\n{"type": "Feature", "properties": {"fid": 1'}
    for name, text in {**fine, **refused}.items():
        file = tmp_path / f"{name}.json"
        file.write_text(text, newline="")
        read = layers.read_geojson(spark, str(file), "fid int", by_line=True)
        if name in fine:
            assert sorted(r.fid for r in read.collect()) == [0, 1, 2, 3], name
        else:
            with pytest.raises(Exception, match="not one feature a line"):
                read.collect()


@pytest.mark.parametrize("buckets", [2, 5, 256])
def test_positions_of_a_dimension(spark, buckets):
    from gridloom.operators.ranks import dimension

    values = [None, "", "a", "b", "a", "é", "B", *(f"v{k % 700}" for k in range(2000))]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = dimension(df, "v", "idx", buckets).collect()
    want = sorted({v for v in values if v is not None}, key=lambda v: v.encode())
    assert sorted((r.idx, r.v) for r in got) == list(enumerate(want))
    assert dimension(df.where("v is null"), "v", "idx", buckets).collect() == []


def test_holes_and_several_parts(spark, tmp_path):
    square = lambda lo, hi: [(lo, lo), (hi, lo), (hi, hi), (lo, hi), (lo, lo)]
    parts = [[square(0.0, 100.0), square(30.0, 70.0)], [square(120.0, 150.0)]]
    polygon = lambda rs: b"\x01" + struct.pack("<II", 3, len(rs)) + b"".join(
        struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in rs
    )
    many = b"\x01" + struct.pack("<II", 6, len(parts)) + b"".join(map(polygon, parts))
    text = json.dumps({"type": "MultiPolygon", "coordinates": parts})
    one = json.dumps({"type": "Polygon", "coordinates": parts[0]})
    rows = [(0, many, text), (1, polygon(parts[0]), one), (2, None, None)]
    spark.createDataFrame(rows, "fid int, w binary, g string").write.parquet(str(tmp_path / "layer"))
    for geometry in ("w", "g"):
        layer = polygons.with_parts_geometry(layers.read_features(spark, str(tmp_path / "layer"), geometry))
        area = {r.fid: r.a for r in layer.select("fid", rings.area_of_parts(F.col("parts")).alias("a")).collect()}
        assert area == {0: 10000 - 1600 + 900, 1: 10000 - 1600, 2: None}
        burned = polygons.burned_pixels(layer, 0.0, 150.0, 10.0, ["fid"])
        assert {r.fid: r["count"] for r in burned.groupBy("fid").count().collect()} == {0: 84 + 9, 1: 84}


@pytest.mark.parametrize(
    "lon,lat,epsg",
    [(-123.1, 44.6, "EPSG:32610"), (151.2, -33.9, "EPSG:32756"), (5.3, 60.4, "EPSG:32632"),
     (8.0, 78.0, "EPSG:32631"), (20.0, 78.0, "EPSG:32633"), (-180.0, 10.0, "EPSG:32601"), (180.0, 10.0, "EPSG:32601")],
)
def test_utm_zone(spark, lon, lat, epsg):
    assert spark.range(1).select(rings.utm_epsg(F.lit(lon), F.lit(lat))).collect()[0][0] == epsg


def test_rows_of_cells_carry_only_their_edges(spark):
    """A ring of 10,000 vertices over 100 rows of cells."""
    n = 10_000
    points = [(500 + 490 * math.cos(2 * math.pi * k / n), 500 + 490 * math.sin(2 * math.pi * k / n)) for k in range(n)]
    points.append(points[0])
    df = spark.createDataFrame([(1, points)], "fid int, ring array<struct<x:double,y:double>>")
    cells = polygons.polygon_cells(polygons.with_geometry(df), F.lit(0.0), F.lit(1000.0), 10.0, 1000.0)
    held = {r.r: r.n for r in cells.select("r", F.size("edges").alias("n")).collect()}
    assert len(held) >= 98
    for row, count in held.items():
        low, high = 1000 - 10 * (row + 1), 1000 - 10 * row
        want = sum(
            max(a[1], b[1]) >= low and min(a[1], b[1]) <= high for a, b in zip(points, points[1:])
        )
        assert count == want
    assert sum(held.values()) < 1.1 * n


def test_cells_of_a_large_outline_grow_with_edges_and_cells(spark):
    """A star of 100,000 vertices over 1,000 rows of cells: whole cells come from runs, not from edge tests."""
    n = 100_000
    angle = 2 * math.pi * np.arange(n) / n
    radius = 4900 + 90 * np.sin(37 * angle)
    x, y = 5000 + radius * np.cos(angle), 5000 + radius * np.sin(angle)
    points = [(float(a), float(b)) for a, b in zip(x, y)]
    points.append(points[0])
    df = spark.createDataFrame([(1, points)], f"fid int, ring {RING}")
    layer = polygons.with_geometry(df).drop("ring")
    bands = polygons.polygon_bands(layer, F.lit(10000.0), 10.0)
    held = bands.select(F.size("edges").alias("n"), F.spark_partition_id().alias("p")).collect()
    assert len(held) >= 990 and sum(r.n for r in held) < 1.2 * n
    assert len({r.p for r in held}) > 1
    cells = polygons.polygon_cells(layer, F.lit(0.0), F.lit(10000.0), 10.0, 10.0)
    got = {}
    for r in cells.groupBy("r").agg(F.count("c").alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi")).collect():
        got[r.r] = (r.n, r.lo, r.hi)
    # the outline meets a row in one run of cells
    low, high = np.minimum(y, np.roll(y, -1)), np.maximum(y, np.roll(y, -1))
    for row in range(100, 900, 50):
        bottom, top = 10000 - 10 * (row + 1), 10000 - 10 * row
        met = (high >= bottom) & (low <= top)
        inside = met & (y >= bottom) & (y <= top)
        lo, hi = math.floor(x[inside].min() / 10), math.floor(x[inside].max() / 10)
        count, first, last = got[row]
        assert count == last - first + 1
        assert abs(first - lo) <= 1 and abs(last - hi) <= 1


def test_long_edges_and_level_edges(spark):
    """Slanted edges over many cells and rows, level and upright edges on and beside the borders."""
    rng = random.Random(5)
    shapes = [
        [(0.0, 0.0), (990.0, 13.0), (0.0, 26.0), (0.0, 0.0)],
        [(5.0, 300.0), (995.0, 300.0), (995.0, 310.0), (5.0, 310.0), (5.0, 300.0)],
        [(200.0, 0.0), (200.0, 600.0), (230.0, 600.0), (230.0, 0.0), (200.0, 0.0)],
        [(7.0, 7.0), (7.0, 7.0)],
        *[[(rng.uniform(0, 1000), rng.uniform(0, 600)) for _ in range(3)] for _ in range(30)],
    ]
    shapes = [s if s[0] == s[-1] else s + s[:1] for s in shapes]
    df = spark.createDataFrame([(k, s) for k, s in enumerate(shapes)], f"fid int, ring {RING}")
    cells = polygons.polygon_cells(polygons.with_geometry(df), F.lit(0.0), F.lit(600.0), 10.0, 20.0)
    rows = cells.select("fid", "r", "c").collect()
    got = {(r.fid, r.r, r.c) for r in rows}
    assert len(got) == len(rows)
    for k, s in enumerate(shapes):
        xs, ys = [p[0] for p in s], [p[1] for p in s]
        want = {
            (k, r, c)
            for r in range(int((600 - max(ys)) // 10) - 1, int((600 - min(ys)) // 10) + 2)
            for c in range(int(min(xs) // 20) - 1, int(max(xs) // 20) + 2)
            if touches(s, (c * 20, 600 - (r + 1) * 10, (c + 1) * 20, 600 - r * 10))
        }
        assert {g for g in got if g[0] == k} == want, k

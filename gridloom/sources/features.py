"""Vector layers: ring arrays, GeoJSON text, WKB."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from gridloom.operators.ranks import lookup_join

POLYGON = "type string, coordinates array<array<array<double>>>"
MULTIPOLYGON = "type string, coordinates array<array<array<array<double>>>>"


def read_features(spark: SparkSession, path: str, geometry: str = "ring") -> DataFrame:
    """A parquet layer whose geometry column holds a ring array, GeoJSON text or WKB.

    Text and bytes give ``parts`` (polygons, each an outer ring and its holes) and ``ring``,
    the outer ring of the first part.
    """
    df = spark.read.parquet(path)
    kind = df.schema[geometry].dataType.typeName()
    if kind == "string":
        return _with_ring(df.withColumn("parts", parts_from_geojson(F.col(geometry))))
    if kind == "binary":
        return _with_ring(with_wkb_parts(df, geometry))
    return df.withColumnRenamed(geometry, "ring")


def read_geojson(spark: SparkSession, path: str, properties: str, by_line: bool = False) -> DataFrame:
    """The features of FeatureCollection files; ``properties`` is a DDL schema.

    Geometries stay text until they are parsed, so polygons and multi-polygons can mix.  A file is
    read whole by one task unless its features stand on lines of their own, as most writers lay
    them out: with ``by_line`` a file is split at its lines like any text.  A feature that does not
    stand on one line is an error then, so none is lost.
    """
    if by_line:
        features = _features_of_lines(spark.read.text(path), properties)
    else:
        schema = f"features array<struct<properties: struct<{properties}>, geometry: string>>"
        raw = spark.read.schema(schema).option("multiLine", True).json(path)
        features = raw.select(F.explode("features").alias("f"))
    return _with_ring(
        features.select("f.properties.*", parts_from_geojson(F.col("f.geometry")).alias("parts"))
    )


def _features_of_lines(lines: DataFrame, properties: str) -> DataFrame:
    """Features ``f`` of the lines of FeatureCollection files; the lines around them give none."""
    schema = f"array<struct<type: string, properties: struct<{properties}>, geometry: string>>"
    body = F.regexp_replace("value", r"^\s+|\s*,?\s*$", "")
    read = F.from_json(F.concat(F.lit("["), body, F.lit("]")), schema)
    found = F.filter(read, lambda f: f["type"] == "Feature")
    names_one = F.col("value").rlike(r'"type"\s*:\s*"Feature"')
    broken = F.raise_error(F.concat(F.lit("not one feature a line: "), F.substring("value", 1, 200)))
    kept = lines.select("value", found.alias("found")).select(
        F.when(names_one & (F.coalesce(F.size("found"), F.lit(0)) < 1), broken.cast(schema))
        .otherwise(F.col("found")).alias("found")
    )
    # an inner explode would have the optimiser parse every line again in a filter of its own
    return kept.select(F.explode_outer("found").alias("f")).where(F.col("f").isNotNull())


def write_geojson(df: DataFrame, path: str, geometry: str) -> None:
    """FeatureCollection files of GeoJSON text ``geometry``, all other columns as properties.

    Every task writes a whole collection with one feature a line; an empty one holds none.
    """
    rest = F.to_json(F.struct(*[c for c in df.columns if c != geometry]), {"ignoreNullFields": "false"})
    shape = F.coalesce(F.regexp_replace(geometry, r"[\r\n]+", " "), F.lit("null"))
    line = F.concat(
        F.lit('{"type":"Feature","properties":'), rest, F.lit(',"geometry":'), shape, F.lit("}")
    )

    def framed(frames):
        yield pd.DataFrame({"value": ['{"type":"FeatureCollection","features":[']})
        held = []  # the last line so far: only it has no comma
        for frame in frames:
            lines = held + frame["value"].tolist()
            held = lines[-1:]
            yield pd.DataFrame({"value": [x + "," for x in lines[:-1]]}, dtype=object)
        yield pd.DataFrame({"value": [*held, "]}"]})

    df.select(line.alias("value")).mapInPandas(framed, "value string").write.text(path)


def with_positions(spark: SparkSession, path: str, position: str = "position") -> DataFrame:
    """The rows of a stored layer with their place in it, counted from 0 over its files by name.

    A row's place follows from the files alone: its number within its file and the rows of the files
    before.  Nothing is sorted or shuffled but one count per file, so any split of the scan gives the
    same places.
    """
    layer = spark.read.parquet(path).select(
        "*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.row_index").alias("row_"))
    files = layer.groupBy("file_").agg(F.count(F.lit(1)).alias("rows_"))  # one row per file
    before = files.select(
        "file_", (F.sum("rows_").over(W.orderBy("file_")) - F.col("rows_")).alias("before_"))
    return lookup_join(layer, before, ["file_"]).withColumn(
        position, F.col("before_") + F.col("row_")).drop("file_", "row_", "before_")


def _with_ring(df: DataFrame) -> DataFrame:
    return df.withColumn("ring", F.get(F.get("parts", F.lit(0)), F.lit(0)))


def _ring(points: Column) -> Column:
    return F.transform(
        points, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    )


def parts_from_geojson(text: Column) -> Column:
    """Every polygon of a GeoJSON Polygon or MultiPolygon, holes included."""
    single = F.array(F.transform(F.from_json(text, POLYGON)["coordinates"], _ring))
    several = F.transform(
        F.from_json(text, MULTIPOLYGON)["coordinates"], lambda part: F.transform(part, _ring)
    )
    kind = F.get_json_object(text, "$.type")
    unknown = F.raise_error(F.concat(F.lit("not a polygon: "), F.coalesce(kind, text)))
    return (
        F.when(text.isNull(), F.lit(None))
        .when(kind == "Polygon", single)
        .when(kind == "MultiPolygon", several)
        .otherwise(unknown.cast("array<array<array<struct<x:double,y:double>>>>"))
    )


def ring_from_geojson(text: Column) -> Column:
    """Outer ring of a GeoJSON polygon."""
    return F.get(F.get(parts_from_geojson(text), F.lit(0)), F.lit(0))


def _header(wkb: bytes, start: int) -> tuple[str, int, int, int]:
    """Byte order, plain kind, numbers per vertex, and where the body begins.

    Z, M and ZM are marked by thousands or by high bits, an SRID by a high bit of its own.
    """
    order = "<" if wkb[start] == 1 else ">"
    code = struct.unpack_from(order + "I", wkb, start + 1)[0]
    plain = code & 0x0FFFFFFF
    more = bool(code & 0x80000000) + bool(code & 0x40000000) + (0, 1, 1, 2)[plain // 1000 % 4]
    return order, plain % 1000, 2 + more, start + 5 + (4 if code & 0x20000000 else 0)


def _polygon(wkb: bytes, start: int) -> tuple[list[np.ndarray], int]:
    """Rings of one polygon as ``x0, y0, x1, y1, ...``, and where it ends."""
    order, _, width, at = _header(wkb, start)
    count = struct.unpack_from(order + "I", wkb, at)[0]
    at, found = at + 4, []
    for _ in range(count):
        n = struct.unpack_from(order + "I", wkb, at)[0]
        ring = np.frombuffer(wkb, dtype=order + "f8", count=width * n, offset=at + 4)
        found.append(ring.reshape(n, width)[:, :2].astype("f8").ravel())
        at += 4 + 8 * width * n
    return found, at


def _vertices(wkb: bytes) -> list[list[np.ndarray]]:
    order, kind, _, at = _header(wkb, 0)
    if kind == 3:
        return [_polygon(wkb, 0)[0]]
    if kind != 6:
        raise ValueError(f"geometry kind {kind} is neither a polygon nor a multipolygon")
    parts, count = [], struct.unpack_from(order + "I", wkb, at)[0]
    at += 4
    for _ in range(count):
        part, at = _polygon(wkb, at)
        parts.append(part)
    return parts


@F.pandas_udf(T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))
def _wkb_vertices(wkb: pd.Series) -> pd.Series:
    return wkb.map(lambda b: None if b is None else _vertices(bytes(b)))


def with_wkb_parts(df: DataFrame, geometry: str) -> DataFrame:
    """Add the parts of a WKB Polygon or MultiPolygon column.

    Spark stores WKB but exposes no vertices, so the bytes are read in Arrow batches; the
    rings themselves are built by expressions.
    """
    def ring(flat: Column) -> Column:
        index = F.sequence(F.lit(0), F.size(flat) - 2, F.lit(2))
        return F.transform(
            F.when(F.size(flat) >= 2, index),
            lambda k: F.struct(F.get(flat, k).alias("x"), F.get(flat, k + 1).alias("y")),
        )

    parts = F.transform("flat_", lambda part: F.transform(part, ring))
    return df.withColumn("flat_", _wkb_vertices(F.col(geometry))).withColumn("parts", parts).drop("flat_")

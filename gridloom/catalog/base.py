"""Registration, the input views, and rounding shared by queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.functions import rings

TABLES = ["customer", "embeddings", "events", "lineitem", "orders", "part", "supplier"]
BANDS = ["b1", "b2", "b3", "b4", "b5", "b6"]
SCALE = 30.0
MAXY = 1200.0
WIDTH = 40  # pixels across; the height grows with the tables

# One text per view, read by Spark and by DuckDB alike.  Every view covers its whole table,
# and the grid gets taller as the tables grow, so work and output grow with the data.
VIEWS = {
    "observations": """
SELECT l_orderkey AS scene_id,
       CASE l_returnflag WHEN 'A' THEN 'LT05' WHEN 'N' THEN 'LE07' ELSE 'LC08' END AS sensor,
       l_shipdate AS acquired, CAST(year(l_shipdate) AS INT) AS yr,
       CAST(floor(l_partkey / 40e0) AS INT) AS yi, CAST(l_partkey % 40 AS INT) AS xi,
       1200e0 - 30e0 * floor(l_partkey / 40e0) AS lat, 30e0 * (l_partkey % 40) AS lon,
       CAST(l_quantity AS INT) + CASE WHEN l_partkey % 11 = 3 THEN 128 ELSE 0 END AS qa,
       l_discount AS b1, l_tax AS b2, l_discount + l_tax AS b3,
       l_extendedprice / 100000e0 AS b4, l_quantity / 50e0 AS b5, l_linenumber / 7e0 AS b6
FROM {lineitem}""",
    "cube": """
SELECT yi, xi, lat, lon, yr, CAST(yr - 1995 AS INT) AS t,
       CAST(floor(yi / 8e0) * 5 + floor(xi / 8e0) AS INT) AS tile_id, count(*) AS n_obs,
       median(b1) AS b1, median(b2) AS b2, median(b3) AS b3,
       median(b4) AS b4, median(b5) AS b5, median(b6) AS b6
FROM {observations}
WHERE (qa & 8) = 0 AND (qa & 16) = 0
GROUP BY yi, xi, lat, lon, yr""",
    "features": """
SELECT o_orderkey AS fid, o_orderpriority AS label, CAST(year(o_orderdate) AS INT) AS yr,
       30e0 * (o_custkey % 37) + 7.3e0 AS x0,
       1200e0 - 30e0 * floor(o_orderkey / 300e0) - 97.13e0 AS y0,
       40e0 + 20e0 * (o_orderkey % 5) AS w, 40e0 + 20e0 * (o_custkey % 4) AS h
FROM {orders}""",
    "scenes": """
SELECT o_orderkey AS scene_id,
       CASE o_orderstatus WHEN 'F' THEN 'LT05' WHEN 'O' THEN 'LE07' ELSE 'LC08' END AS sensor,
       o_orderdate AS acquired, CAST(o_custkey % 100 AS INT) AS cloud_pct,
       30e0 * (o_custkey % 30) - 203e0 AS minx,
       600e0 - 30e0 * floor(o_orderkey / 300e0) - 203e0 AS miny,
       30e0 * (o_custkey % 30) + 397e0 AS maxx,
       1200e0 - 30e0 * floor(o_orderkey / 300e0) - 203e0 AS maxy
FROM {orders}""",
    "cloud_prob": """
SELECT l_orderkey AS scene_id, l_linenumber AS seq, l_partkey AS src,
       l_discount * 1000e0 AS probability
FROM {lineitem}""",
    "rasters": """
SELECT CAST(floor(p_partkey / 640e0) AS INT) AS img,
       CAST(CAST(floor(p_partkey / 40e0) AS BIGINT) % 16 AS INT) AS yi,
       CAST(p_partkey % 40 AS INT) AS xi,
       CAST((p_partkey * 37) % 101 AS DOUBLE) AS prob, p_size * 200e0 AS nir,
       CAST(p_partkey % 9 AS INT) AS scl,
       33e0 + 25e0 * (CAST(floor(p_partkey / 640e0) AS BIGINT) % 7) AS sun_azimuth,
       p_size / 50e0 AS soft, CAST(p_size % 2 AS DOUBLE) AS pred,
       CASE WHEN (p_partkey * 13) % 7 < 4 THEN 1e0 ELSE 0e0 END AS target
FROM {part}""",
    "predictions": """
SELECT CAST(floor(l_orderkey / 100e0) AS INT) AS img, CAST(l_linenumber % 3 AS INT) AS pred_class,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS true_class,
       l_discount * 10e0 AS score, CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS target,
       l_quantity / 10e0 - 2.5e0 AS z0, l_tax * 50e0 - 2e0 AS z1, l_linenumber / 2e0 - 2e0 AS z2
FROM {lineitem}""",
    "embedding_pairs": """
SELECT a.vec_id AS vec_id, a.label AS label, a.embedding AS emb_a, b.embedding AS emb_b
FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1""",
    "checkpoints": """
SELECT user_id AS run_id, event_id,
       concat('epoch=', lpad(CAST(event_id % 200 AS VARCHAR(20)), 4, '0'),
              CASE event_id % 4 WHEN 0 THEN '_val_f1=' WHEN 1 THEN '_test/iou@50=' ELSE '_val_loss=' END,
              CAST(CAST(floor(value / 10e0) / 10e0 AS DECIMAL(10,3)) AS VARCHAR(20)),
              CASE WHEN event_id % 3 = 0
                   THEN concat('-v', CAST(event_id % 4 AS VARCHAR(20))) ELSE '' END, '.ckpt') AS path
FROM {events}""",
    "splits": """
SELECT DISTINCT tile_id, t,
       CASE tile_id % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validate' ELSE 'train' END AS split
FROM {cube}""",
    "params": """
SELECT CAST(o_orderkey % 4 AS INT) AS model, CAST(floor(o_orderkey / 4e0) AS BIGINT) AS pos,
       concat('block_', CAST(CAST(floor(o_orderkey / 4e0) AS BIGINT) % 3 AS VARCHAR(20)), '.weight') AS name,
       o_totalprice / 100000e0 AS value
FROM {orders}""",
}


def _names(text: str) -> list[str]:
    return [n for n in [*VIEWS, *TABLES] if "{" + n + "}" in text]


class Inputs:
    """The views of one data folder as DataFrames, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                text = VIEWS[name]
                parts = {n: getattr(self, n) for n in _names(text)}
                self._made[name] = self.spark.sql(text, **parts)
            else:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._made[name]

    @property
    def polygons(self) -> DataFrame:
        """Features with their ring, bounding box and edges."""
        from gridloom.operators.polygons import with_geometry

        x0, y0, w, h = (F.col(c) for c in ("x0", "y0", "w", "h"))
        ring = rings.ring_of((x0, y0), (x0 + w, y0), (x0, y0 + h))
        return with_geometry(self.features.withColumn("ring", ring))

    @property
    def extent(self) -> DataFrame:
        """First and last pixel label per axis, widened to whole pixels, from the data."""
        return self.observations.agg(
            F.min("lon").alias("minx"),
            (F.min("lat") - SCALE).alias("miny"),
            (F.max("lon") + SCALE).alias("maxx"),
            F.max("lat").alias("maxy"),
        )


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


@lru_cache(maxsize=None)
def _closure(name: str) -> tuple[str, ...]:
    """A view and the views below it, dependencies first."""
    out: list[str] = []
    for dep in _names(VIEWS[name]):
        if dep in VIEWS:
            out += [d for d in _closure(dep) if d not in out]
    return (*out, name)


def oracle(body: str, ctes: str = "") -> str:
    """DuckDB text: the views that ``{name}`` mentions, then ``ctes``, then the body."""
    wanted: list[str] = []
    for name in _names(ctes + body):
        if name in VIEWS:
            wanted += [v for v in _closure(name) if v not in wanted]
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in wanted]
    if ctes.strip():
        parts.append(ctes.strip())
    text = (("WITH " + ",\n".join(parts) + "\n") if parts else "") + body.strip()
    for name in [*VIEWS, *TABLES]:
        text = text.replace("{" + name + "}", name)
    return text


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register ``fn(inputs) -> DataFrame`` under ``name`` with its SQL twin."""
    def keep(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if sql is not None:
            ORACLES[name] = oracle(sql, ctes)
        return fn

    return keep


# Short decimals can sit exactly on a rounding tie, where the engines differ; the nudge moves
# them off it, and adding zero folds -0.0 into 0.0.
NUDGE = "1.234567e-8"


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round for comparison."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + F.lit(float(NUDGE)), digits) + F.lit(0.0)


def s6(expr: str, digits: int = 6) -> str:
    return f"(round(CAST({expr} AS DOUBLE) + {NUDGE}, {digits}) + 0e0)"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, digits) for c in columns})


CHUNK = 4  # pixels per chunk side in the queries
G = CHUNK * SCALE

TRIANGLES = """
tri AS (SELECT fid, label, yr, x0, y0, w, h, x0 AS minx, y0 AS miny, x0 + w AS maxx, y0 + h AS maxy
        FROM {features})"""

EXTENT = """
ext AS (SELECT min(lon) AS minx, min(lat) - 30e0 AS miny, max(lon) + 30e0 AS maxx, max(lat) AS maxy
        FROM {observations})"""

# full chunks of 4 x 4 pixels over the data's extent
CHUNKS = EXTENT + """,
dims AS (SELECT *, CAST(floor((maxy - miny) / 120e0) AS INT) AS nr,
                CAST(floor((maxx - minx) / 120e0) AS INT) AS nc FROM ext),
chunks AS (
  SELECT CAST(r.r * nc + c.c AS BIGINT) AS chunk_id, CAST(r.r AS INT) AS r, CAST(c.c AS INT) AS c,
         maxy - r.r * 120e0 AS ty, minx + c.c * 120e0 AS tx
  FROM dims, generate_series(0, nr - 1) r(r), generate_series(0, nc - 1) c(c))"""

# closed triangle-box test: a right triangle meets a box iff its bounding box does and the box
# point nearest its right angle lies on the inner side of the slanted edge
HITS = CHUNKS + ",\n" + TRIANGLES.strip() + """,
hits AS (
  SELECT k.chunk_id, k.r, k.c, k.ty, k.tx, t.fid, t.label, t.yr
  FROM chunks k JOIN tri t ON t.minx <= k.tx + 120e0 AND t.maxx >= k.tx
                          AND t.miny <= k.ty AND t.maxy >= k.ty - 120e0
  WHERE (greatest(k.tx, t.x0) - t.x0) / t.w + (greatest(k.ty - 120e0, t.y0) - t.y0) / t.h <= 1e0)"""

# (pixel, polygon) pairs by brute force: pixel centres strictly inside each triangle
BURN = """
tallest AS (SELECT CAST(max(yi) AS INT) AS top FROM {observations}),
burn AS (
  SELECT f.fid, f.label, f.yr, CAST(y.yi AS INT) AS yi, CAST(x.xi AS INT) AS xi
  FROM tallest, generate_series(0, top) y(yi), generate_series(0, 39) x(xi), {features} f
  WHERE 30e0 * xi + 15e0 > f.x0 AND 1200e0 - 30e0 * yi - 15e0 > f.y0
    AND (30e0 * xi + 15e0 - f.x0) / f.w + (1200e0 - 30e0 * yi - 15e0 - f.y0) / f.h < 1e0)"""

"""Pooling and mosaicking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.base import query, rounded, s6
from gridloom.functions.indices import ndvi
from gridloom.operators import patches


@query(
    "a11_sum_pool",
    """SELECT img, CAST(yi // 4 AS INT) AS pr, CAST(xi // 4 AS INT) AS pc, sum(target) AS total FROM {rasters}
       GROUP BY 1, 2, 3 HAVING sum(target) > 8""",
)
def a11(i):
    return patches.sum_pool(i.rasters, ["img"], "target", 4, "total", minimum=8.0)


@query(
    "a12_patch_means",
    f"""
SELECT pr, pc, {s6('m2')} AS before, {s6('m5')} AS after FROM (
  SELECT CAST(yi // 2 AS INT) AS pr, CAST(xi // 2 AS INT) AS pc,
    CASE WHEN count(*) FILTER (t = 2) = count(nd) FILTER (t = 2) THEN avg(nd) FILTER (t = 2) END AS m2,
    CASE WHEN count(*) FILTER (t = 5) = count(nd) FILTER (t = 5) THEN avg(nd) FILTER (t = 5) END AS m5
  FROM (SELECT *, CASE WHEN b2 + b1 <> 0 THEN (b2 - b1) / (b2 + b1) END AS nd FROM {{cube}}) GROUP BY 1, 2)
WHERE m2 IS NOT NULL AND m5 IS NOT NULL""",
)
def a12(i):
    indexed = i.cube.withColumn("nd", ndvi(F.col("b2"), F.col("b1")))
    return rounded(
        patches.patch_means(indexed, [], "nd", 2, "t", {2: "before", 5: "after"}), "before", "after"
    )


@query(
    "a13_running_mean",
    f"SELECT yi, xi, t, band, {s6('avg(v)')} AS v, count(*) AS n FROM placed GROUP BY 1, 2, 3, 4",
    """placed AS (SELECT yi, xi, yr - 1995 AS t, CAST(l AS INT) AS band, CASE l WHEN 0 THEN b4 ELSE b5 END AS v
                  FROM {observations}, generate_series(0, 1) g(l))""",
)
def a13(i):
    placed = i.observations.select(
        "yi", "xi", (F.col("yr") - 1995).alias("t"), F.posexplode(F.array("b4", "b5")).alias("band", "v")
    )
    return rounded(patches.overlap_mean(placed, ["yi", "xi", "t", "band"], ["v"], "n"), "v")


@query(
    "a14_last_write",
    f"""SELECT yi, xi, {s6('b4')} AS b4, {s6('b5')} AS b5 FROM (
          SELECT *, row_number() OVER (PARTITION BY yi, xi ORDER BY acquired DESC, scene_id DESC, b4 DESC, b5 DESC) AS rn
          FROM {{observations}}) WHERE rn = 1""",
)
def a14(i):
    order = ["acquired", "scene_id", "b4", "b5"]
    return rounded(patches.last_write(i.observations, ["yi", "xi"], ["b4", "b5"], order), "b4", "b5")

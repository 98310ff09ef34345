"""Scalar and array function queries, names and dates, configured steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.base import BURN, MAXY, SCALE, query, r6, rounded, s6
from gridloom.functions import indices, text, vectors
from gridloom.operators import registry, sampling, stats


def _index_sql(a: str, b: str) -> str:
    return f"""SELECT yi, xi, t, {s6(f'CASE WHEN {a} + {b} <> 0 THEN ({a} - {b}) / ({a} + {b}) END')} AS v
               FROM {{cube}}"""


@query("f1_ndvi", _index_sql("b4", "b3"))
def f1(i):
    return i.cube.select("yi", "xi", "t", r6(indices.ndvi(F.col("b4"), F.col("b3"))).alias("v"))


@query("f2_ndwi", _index_sql("b4", "b6"))
def f2(i):
    return i.cube.select("yi", "xi", "t", r6(indices.ndwi(F.col("b4"), F.col("b6"))).alias("v"))


@query("f3_nbr", _index_sql("b4", "b6"))
def f3(i):
    return i.cube.select("yi", "xi", "t", r6(indices.nbr(F.col("b4"), F.col("b6"))).alias("v"))


@query(
    "f4_band_z_score",
    f"""SELECT yi, xi, t, {s6('(b1 - m1) / s1')} AS b1, {s6('(b4 - m4) / s4')} AS b4
        FROM {{cube}}, (SELECT avg(b1) AS m1, stddev_pop(b1) AS s1, avg(b4) AS m4, stddev_pop(b4) AS s4
                        FROM {{cube}})""",
)
def f4(i):
    table = stats.band_stats(i.cube, ["b1", "b4"])
    scored = stats.normalise_bands(i.cube.select("yi", "xi", "t", "b1", "b4"), table, ["b1", "b4"])
    return rounded(scored, "b1", "b4")


@query(
    "f5_binary_step",
    "SELECT yi, xi, t, CASE WHEN b4 - b5 > 0 THEN 1e0 ELSE 0e0 END AS step FROM {cube}",
)
def f5(i):
    return i.cube.select("yi", "xi", "t", indices.binary_step(F.col("b4") - F.col("b5")).alias("step"))


@query(
    "f6_prepend_background",
    """SELECT yi, xi, t, CAST(k + 1 AS INT) AS cls, CASE k WHEN 0 THEN c0 ELSE c1 END AS value
       FROM planes, generate_series(0, 1) g(k)
       UNION ALL SELECT yi, xi, t, 0, CASE WHEN c0 + c1 = 0 THEN 1e0 ELSE 0e0 END FROM planes""",
    """planes AS (SELECT yi, xi, t, CASE WHEN b1 > 0.05e0 THEN 1e0 ELSE 0e0 END AS c0,
                         CASE WHEN b2 > 0.045e0 THEN 1e0 ELSE 0e0 END AS c1 FROM {cube})""",
)
def f6(i):
    flag = lambda c, lo: F.when(F.col(c) > lo, 1.0).otherwise(0.0)
    planes = i.cube.select(
        "yi", "xi", "t", F.posexplode(F.array(flag("b1", 0.05), flag("b2", 0.045))).alias("cls", "value")
    )
    return sampling.prepend_background(planes, ["yi", "xi", "t"], "cls", "value")


@query(
    "f7_activations",
    f"""SELECT img, pred_class, {s6('1e0 / (1e0 + exp(-z0))')} AS s0,
               {s6('exp(z0) / (exp(z0) + exp(z1) + exp(z2))')} AS p0,
               {s6('exp(z1) / (exp(z0) + exp(z1) + exp(z2))')} AS p1,
               {s6('exp(z2) / (exp(z0) + exp(z1) + exp(z2))')} AS p2 FROM {{predictions}}""",
)
def f7(i):
    z = vectors.softmax(F.array("z0", "z1", "z2"))
    rows = i.predictions.select("img", "pred_class", vectors.sigmoid(F.col("z0")).alias("s0"), z.alias("p"))
    return rows.select(
        "img", "pred_class", r6("s0").alias("s0"), *[r6(F.get("p", F.lit(k))).alias(f"p{k}") for k in range(3)]
    )


@query(
    "o4_argmax_class",
    """SELECT img, pred_class, CAST(CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END AS INT)
         AS top, count(*) AS n FROM {predictions} GROUP BY 1, 2, 3""",
)
def o4(i):
    top = vectors.argmax(F.array("z0", "z1", "z2")).alias("top")
    return i.predictions.select("img", "pred_class", top).groupBy("img", "pred_class", "top").agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "f12_names",
    """SELECT event_id, CAST(event_id % 200 AS INT) AS epoch, CAST(CAST(floor(value / 10e0) / 10e0 AS DECIMAL(10,3)) AS DOUBLE) AS metric,
              CAST(CASE WHEN event_id % 3 = 0 THEN event_id % 4 ELSE -2 END AS INT) AS version,
              lpad(CAST(event_id AS VARCHAR), 8, '0') || '_t' || lpad(CAST(event_id % 7 AS VARCHAR), 2, '0') AS name
       FROM {events}""",
)
def f12(i):
    p = F.col("path")
    return i.checkpoints.select(
        "event_id",
        text.checkpoint_epoch(p).alias("epoch"),
        text.checkpoint_metric(p).alias("metric"),
        text.checkpoint_version(p).alias("version"),
        text.sample_name(F.col("event_id"), F.col("event_id") % 7).alias("name"),
    )


@query(
    "f13_date_parse",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM {orders}",
)
def f13(i):
    written = F.date_format("o_orderdate", "yyyy-MM-dd")
    return i.orders.select("o_orderkey", text.parse_date(written).alias("day"))


@query(
    "x1_configured_steps",
    f"""SELECT yi, xi, yr, {s6('CASE WHEN b4 + b3 <> 0 THEN (b4 - b3) / (b4 + b3) END')} AS ndvi FROM {{cube}}""",
)
def x1(i):
    config = [
        {"name": "clear_pixels", "args": {"labels": ["cloud", "shadow"]}},
        {"name": "median", "args": {"keys": ["yi", "xi", "yr"], "bands": ["b3", "b4"]}},
        {"name": "append_index", "args": {"index": "ndvi", "a": "b4", "b": "b3"}},
    ]
    return registry.apply_steps(i.observations, config).select("yi", "xi", "yr", r6("ndvi").alias("ndvi"))


@query(
    "x1_composite_annotator_sampler",
    f"""
SELECT p.yi, p.xi, p.yr, {s6('median(p.b4)')} AS b4, max(CASE WHEN b.yi IS NULL THEN 0e0 ELSE 1e0 END) AS burn
FROM {{observations}} p LEFT JOIN (SELECT DISTINCT yi, xi FROM burn) b ON b.yi = p.yi AND b.xi = p.xi
WHERE (qa & 8) = 0 AND (qa & 16) = 0 GROUP BY p.yi, p.xi, p.yr
QUALIFY row_number() OVER (ORDER BY md5(concat_ws(':', p.yi, p.xi, p.yr, '3', '0')), p.yi, p.xi, p.yr)
        <= floor(count(*) OVER () * 0.25e0)""",
    BURN,
)
def x1_chain(i):
    """A composite by a user's own path, an annotator and a sampler by name, the context injected."""
    config = [
        {"name": "clear_pixels"},
        {"name": "gridloom.operators.composites.median_composite", "args": {"bands": ["b4"]}},
        {"name": "burn_labels", "args": {"tile": 16}},
        {"name": "epoch_sample", "args": {"ratio": 0.25}},
    ]
    out = registry.apply_steps(
        i.observations, config, keys=["yi", "xi", "yr"], features=i.polygons, minx=0.0, maxy=MAXY,
        scale=SCALE, seed=3,
    )
    return out.select("yi", "xi", "yr", r6("b4").alias("b4"), "burn")

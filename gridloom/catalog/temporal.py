"""Window queries along the time axis."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from gridloom.catalog.base import query, r6, rounded, s6
from gridloom.operators import composites, temporal


# every step of every pixel, with -1 where the cube has no row
DENSE = """
dense AS (SELECT p.tile_id, p.yi, p.xi, CAST(g.t AS INT) AS t, coalesce(c.b1, -1e0) AS b1, coalesce(c.b4, -1e0) AS b4
          FROM (SELECT DISTINCT tile_id, yi, xi FROM {cube}) p CROSS JOIN generate_series(0, 6) g(t)
          LEFT JOIN {cube} c ON c.yi = p.yi AND c.xi = p.xi AND c.t = g.t)"""


@query(
    "w1_sliding_windows",
    f"""SELECT yi, xi, CAST(a AS INT) AS anchor, CAST(t - a + 3 AS INT) AS k, {s6('b1')} AS b1
        FROM dense, generate_series(3, 6) g(a) WHERE t BETWEEN a - 3 AND a - 1""",
    DENSE,
)
def w1(i):
    out = temporal.sliding_windows(i.cube, ["yi", "xi"], ["b1"], 3, 7)
    return rounded(out.drop("t"), "b1")


@query(
    "w2_asymmetric_windows",
    f"""
SELECT s.tile_id, s.t AS tdx, CAST(c.t - s.t + 1 AS INT) AS k, count(*) AS n, {s6('avg(c.b1)')} AS b1
FROM {{splits}} s JOIN dense c ON c.tile_id = s.tile_id AND c.t BETWEEN s.t + 1 - 2 AND s.t + 1 + 1
WHERE s.t + 1 - 2 >= 0 AND s.t + 1 + 2 <= 7 GROUP BY 1, 2, 3""",
    DENSE,
)
def w2(i):
    anchors = i.splits.select("tile_id", F.col("t").alias("tdx"))
    out = temporal.asymmetric_windows(
        anchors, i.cube, ["tile_id"], ["tile_id", "yi", "xi"], ["b1"], (2, 2), 7, offset=1
    )
    return out.groupBy("tile_id", "tdx", "k").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("b1")).alias("b1"))


@query(
    "w3_anchor_steps",
    """SELECT yi, xi, CAST(a AS INT) AS tdx FROM (SELECT DISTINCT yi, xi FROM {cube}), generate_series(0, 3) g(a)""",
)
def w3(i):
    steps = temporal.anchor_steps(7, (2, 2))
    return i.cube.select("yi", "xi").distinct().withColumn("tdx", F.explode(steps))


@query(
    "w4_holdout_windows",
    f"""
SELECT p.yi, p.xi, p.anchor, CAST(s AS INT) AS shift,
       CASE WHEN s < 0 THEN 'bwd' WHEN s > 0 THEN 'fwd' ELSE 'cur' END AS segment,
       CAST(c.t - (p.anchor + s - 2) AS INT) AS k, {s6('c.b1')} AS b1
FROM (SELECT DISTINCT yi, xi, CAST(CAST('0x' || substr(md5(concat_ws(':', yi, xi, '11', '2')), 1, 15) AS BIGINT) % 3 + 3 AS INT) AS anchor
      FROM {{cube}}) p CROSS JOIN generate_series(-1, 1) g(s)
JOIN dense c ON c.yi = p.yi AND c.xi = p.xi AND c.t BETWEEN p.anchor + s - 2 AND p.anchor + s - 1""",
    DENSE,
)
def w4(i):
    pixels = i.cube.select("yi", "xi").distinct()
    out = temporal.holdout_windows(pixels, i.cube, ["yi", "xi"], ["b1"], 2, 1, 7, seed=11, epoch=2)
    return rounded(out.select("yi", "xi", "anchor", "shift", "segment", "k", "b1"), "b1")


@query(
    "w5_unpack_segments",
    f"""SELECT yi, xi, CASE WHEN t < 2 THEN 'bwd' WHEN t < 4 THEN 'cur' WHEN t < 6 THEN 'fwd' END AS segment,
               CAST(CASE WHEN t < 6 THEN 0 END AS INT) AS k, CAST(t % 2 AS INT) AS tt, {s6('b2')} AS b2 FROM {{cube}}""",
)
def w5(i):
    out = temporal.unpack_segments(i.cube, 2, ["bwd", "cur", "fwd"], [1, 1, 1])
    return rounded(out.select("yi", "xi", "segment", "k", "tt", "b2"), "b2")


@query("w6_reverse_time", f"SELECT yi, xi, CAST(6 - t AS INT) AS t, {s6('b1')} AS b1 FROM {{cube}}")
def w6(i):
    return rounded(temporal.reverse_time(i.cube.select("yi", "xi", "t", "b1"), 7), "b1")


@query(
    "w7_month_ranges",
    """
SELECT o_orderkey, lo AS range_start, CAST(date_trunc('month', lo + INTERVAL 32 DAY) AS DATE) AS range_end FROM (
  SELECT o_orderkey, d AS lo FROM days
  UNION ALL
  SELECT o_orderkey, CAST(unnest(generate_series(date_trunc('month', d + INTERVAL 32 DAY),
         CAST(d + INTERVAL 99 DAY AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) FROM days)""",
    "days AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM {orders})",
)
def w7(i):
    start = F.col("o_orderdate").cast("date")
    out = composites.month_ranges(i.orders.select("o_orderkey", start.alias("d")), F.col("d"), F.date_add("d", 100))
    return out.select("o_orderkey", "range_start", "range_end")


def _diff(bands, terms, spans):
    cols = ", ".join(s6(terms.format(b=b)) + f" AS {b}" for b in bands)
    joins = " ".join(
        f"JOIN {{cube}} c{n} ON c{n}.yi = c.yi AND c{n}.xi = c.xi AND c{n}.t = c.t + {n}" for n in spans
    )
    return f"SELECT c.yi, c.xi, c.t, {cols} FROM {{cube}} c {joins}"


@query("w8_first_difference", _diff(["b1", "b4"], "c1.{b} - c.{b}", [1]))
def w8(i):
    return rounded(temporal.first_difference(i.cube, ["yi", "xi"], ["b1", "b4"]), "b1", "b4")


@query("w9_second_difference", _diff(["b1", "b4"], "c2.{b} - 2 * c1.{b} + c.{b}", [1, 2]))
def w9(i):
    return rounded(temporal.second_difference(i.cube, ["yi", "xi"], ["b1", "b4"]), "b1", "b4")


@query(
    "w10_before_after",
    f"SELECT yi, xi, CAST(CASE t WHEN 4 THEN 0 ELSE 1 END AS INT) AS t, {s6('b1')} AS b1 FROM {{cube}} WHERE t IN (4, 6)",
)
def w10(i):
    return rounded(temporal.before_after(i.cube.select("yi", "xi", "t", "b1"), 7), "b1")


FRAMES = """
frames AS (SELECT CAST(floor(vec_id / 4e0) AS BIGINT) AS img, CAST(vec_id % 4 + vec_id % 4 // 2 AS INT) AS t,
                  CAST(embedding AS DOUBLE[]) AS emb
           FROM {embeddings}),
long AS (SELECT img, t, unnest(emb) AS v, unnest(generate_series(0, 63)) AS pos FROM frames)"""


def frames(i):
    """Four frames per image at the steps 0, 1, 3 and 4: between the second and third one is a gap."""
    k = F.col("vec_id") % 4
    return i.embeddings.select(
        F.floor(F.col("vec_id") / 4).alias("img"), (k + F.floor(k / 2)).cast("int").alias("t"),
        F.col("embedding").cast("array<double>").alias("emb"),
    )


@query(
    "w11_frame_delta",
    f"""SELECT a.img, a.t, CAST(a.pos AS INT) AS pos, {s6('a.v - b.v')} AS value
        FROM long a JOIN long b ON b.img = a.img AND b.pos = a.pos AND b.t = a.t + 1""",
    FRAMES,
)
def w11(i):
    out = temporal.frame_delta(frames(i), ["img"], "emb")
    return out.select("img", "t", F.posexplode("emb").alias("pos", "value")).withColumn("value", r6("value"))


@query(
    "w11_frame_delta_concatenated",
    f"""SELECT img, CAST(pos AS INT) AS pos, {s6('v')} AS value
        FROM (SELECT *, min(t) OVER (PARTITION BY img) AS t0 FROM long) WHERE t = t0
        UNION ALL SELECT img, CAST(64 * rn + pos AS INT), {s6('v')}
        FROM (SELECT a.img, a.pos, a.v - b.v AS v, row_number() OVER (PARTITION BY a.img, a.pos ORDER BY a.t) AS rn
              FROM long a JOIN long b ON b.img = a.img AND b.pos = a.pos AND b.t = a.t + 1)""",
    FRAMES,
)
def w11b(i):
    out = temporal.frame_delta(frames(i), ["img"], "emb", "cat_delta")
    return out.select("img", F.posexplode("emb").alias("pos", "value")).withColumn("value", r6("value"))


@query(
    "w11_frame_stack",
    f"""SELECT img, CAST(64 * (row_number() OVER (PARTITION BY img, pos ORDER BY t) - 1) + pos AS INT) AS pos,
               {s6('v')} AS value FROM long""",
    FRAMES,
)
def w11c(i):
    out = temporal.frame_delta(frames(i), ["img"], "emb", "stack")
    return out.select("img", F.posexplode("emb").alias("pos", "value")).withColumn("value", r6("value"))


@query(
    "w12_year_labels",
    """SELECT yr, CAST(yr - 1995 AS INT) AS t, CAST(7 AS INT) AS years, count(*) AS n FROM {observations} GROUP BY yr""",
)
def w12(i):
    size = composites.year_size(date(1995, 5, 1), date(2001, 9, 30))
    labelled = temporal.time_index(i.observations, "yr", 1995)
    return labelled.groupBy("yr", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("years", F.lit(size))

"""Sampling, splitting and augmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.base import CHUNKS, G, SCALE, WIDTH, query, r6, rounded, s6
from gridloom.catalog.grids import chunks_of
from gridloom.operators import sampling
from gridloom.operators.ranks import lookup_join


def drawn(keys: str, seed: int, n: int, epoch: int = 0) -> str:
    """SQL twin of a reproducible draw in [0, n)."""
    return f"CAST(CAST('0x' || substr(md5(concat_ws(':', {keys}, '{seed}', '{epoch}')), 1, 15) AS BIGINT) % {n} AS INT)"


@query(
    "q1_epoch_sample",
    """SELECT scene_key, epoch FROM (
         SELECT o_orderkey AS scene_key, CAST(e AS INT) AS epoch,
                row_number() OVER (PARTITION BY e ORDER BY md5(concat_ws(':', o_orderkey, '7', e)), o_orderkey) AS rn,
                count(*) OVER (PARTITION BY e) AS n
         FROM {orders}, generate_series(0, 1) g(e)) WHERE rn <= floor(n * 0.3e0)""",
)
def q1(i):
    keys = i.orders.select(F.col("o_orderkey").alias("scene_key"))
    epochs = [
        sampling.epoch_sample(keys, ["scene_key"], 0.3, seed=7, epoch=e).withColumn("epoch", F.lit(e))
        for e in (0, 1)
    ]
    return epochs[0].unionByName(epochs[1])


@query(
    "q2_jitter",
    f"""
SELECT chunk_id, CAST(j AS INT) AS jitter_id, dy, dx, ty + dy AS ty, tx + dx AS tx FROM (
  SELECT chunk_id, ty, tx, j,
         30 - 120 + 30 * {drawn('chunk_id, j', 3, 6)} AS dy, 30 - 120 + 30 * {drawn('chunk_id, j', 4, 6)} AS dx
  FROM chunks, generate_series(0, 2) g(j))""",
    CHUNKS,
)
def q2(i):
    out = sampling.jitter(
        chunks_of(i).select("chunk_id", "ty", "tx"), ["chunk_id"], 3, int(SCALE), int(G), int(G), seed=3
    )
    return out.select("chunk_id", "jitter_id", "dy", "dx", "ty", "tx")


@query(
    "q3_batches",
    """SELECT o_orderkey, rn // 32 AS batch, CAST(rn % 32 AS INT) AS slot FROM (
         SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat_ws(':', o_orderkey, '5', '1')), o_orderkey) - 1 AS rn
         FROM {orders}) WHERE (rn // 32 + 1) * 32 <= (SELECT count(*) FROM {orders})""",
)
def q3(i):
    keys = i.orders.select("o_orderkey")
    return sampling.batches(keys, ["o_orderkey"], 32, seed=5, epoch=1, drop_last=True)


@query(
    "q4_splits",
    f"""
SELECT yi, xi, c.t AS t_in, split, CASE WHEN split = 'train' THEN CAST(6 - c.t AS INT) ELSE c.t END AS t,
       CASE WHEN split = 'test' THEN 0e0 ELSE {s6('b1')} END AS b1
FROM {{cube}} c JOIN {{splits}} s ON s.tile_id = c.tile_id AND s.t = c.t""",
)
def q4(i):
    marked = sampling.split_by_list(i.cube, i.splits, ["tile_id", "t"]).select(
        "yi", "xi", "t", F.col("t").alias("t_in"), "split", r6("b1").alias("b1")
    )
    return sampling.per_split_columns(
        marked, {"train": [{"t": (6 - F.col("t")).cast("int")}], "validate": [], "test": [{"b1": F.lit(0.0)}]}
    )


def square(i):
    """8 x 8 pixel images: the rasters cut into blocks."""
    block = F.floor(F.col("yi") / 8) * 5 + F.floor(F.col("xi") / 8)
    return i.rasters.select(
        "img", block.cast("int").alias("block"),
        F.pmod(F.col("yi"), F.lit(8)).alias("yi"), F.pmod(F.col("xi"), F.lit(8)).alias("xi"),
        "soft", "pred",
    )


SQUARE = """
sq AS (SELECT img, CAST((yi // 8) * 5 + xi // 8 AS INT) AS block, CAST(yi % 8 AS INT) AS yi,
              CAST(xi % 8 AS INT) AS xi, soft, pred FROM {rasters})"""


@query(
    "q5_shared_choice",
    f"""SELECT img, block, yi, choice, CASE choice WHEN 1 THEN 7 - xi ELSE xi END AS xi,
               CASE choice WHEN 2 THEN -soft ELSE soft END AS inpt,
               pred AS target
        FROM (SELECT *, {drawn('img, block', 9, 3, 4)} AS choice FROM sq)""",
    SQUARE,
)
def q5(i):
    blocks = sampling.with_choice(square(i), ["img", "block"], 3, seed=9, epoch=4)
    place = ["img", "block", "yi", "xi"]
    flip = {"xi": F.lit(7) - F.col("xi")}
    negate = {"inpt": -F.col("inpt")}
    # the identity, a flip of both, and a change of the input alone
    inputs, labels = sampling.augment_pair(
        blocks.select(*place, "choice", F.col("soft").alias("inpt")),
        blocks.select(*place, F.col("pred").alias("target")),
        ["img", "block"], [({}, False), (flip, False), (negate, True)], seed=9, epoch=4,
    )
    return inputs.join(labels, place)


@query(
    "q6_random_crop",
    f"""SELECT img, block, CAST(yi - y0 AS INT) AS yi, CAST(xi - x0 AS INT) AS xi, soft FROM (
          SELECT *, {drawn('img, block', 21, 4)} AS y0, {drawn('img, block', 22, 4)} AS x0 FROM sq)
        WHERE yi BETWEEN y0 AND y0 + 4 AND xi BETWEEN x0 AND x0 + 4""",
    SQUARE,
)
def q6(i):
    return sampling.random_crop(square(i), ["img", "block"], 8, 8, 5, seed=21).select(
        "img", "block", "yi", "xi", "soft"
    )


@query(
    "q7_random_affine",
    f"""
SELECT img, block, CAST(CASE WHEN v = 1 THEN 7 - y ELSE y END AS INT) AS yi,
       CAST(CASE WHEN h = 1 THEN 7 - x ELSE x END AS INT) AS xi, soft FROM (
  SELECT *, CASE q WHEN 1 THEN 7 - xi WHEN 2 THEN 7 - yi WHEN 3 THEN xi ELSE yi END AS y,
            CASE q WHEN 1 THEN yi WHEN 2 THEN 7 - xi WHEN 3 THEN 7 - yi ELSE xi END AS x
  FROM (SELECT *, {drawn('img, block', 31, 4)} AS q, {drawn('img, block', 32, 2)} AS h, {drawn('img, block', 33, 2)} AS v
        FROM sq))""",
    SQUARE,
)
def q7(i):
    return sampling.random_affine(square(i), ["img", "block"], 8, seed=31).select(
        "img", "block", "yi", "xi", "soft"
    )


@query(
    "q8_colour_jitter",
    f"""
SELECT img, block, yi, xi, {s6('least(greatest(b * fc + (1 - fc) * avg(b) OVER (PARTITION BY img, block), 0e0), 1e0)')} AS soft
FROM (SELECT *, least(greatest(soft * fb, 0e0), 1e0) AS b FROM (
  SELECT *, 0.6e0 + 0.8e0 * (CAST('0x' || substr(md5(concat_ws(':', img, block, '41', '0')), 1, 15) AS BIGINT) / 1152921504606846976e0) AS fb,
            0.7e0 + 0.6e0 * (CAST('0x' || substr(md5(concat_ws(':', img, block, '42', '0')), 1, 15) AS BIGINT) / 1152921504606846976e0) AS fc
  FROM sq))""",
    SQUARE,
)
def q8(i):
    out = sampling.colour_jitter(square(i), ["img", "block"], ["soft"], 0.4, 0.3, seed=41)
    return rounded(out.select("img", "block", "yi", "xi", "soft"), "soft")


@query(
    "q10_patch_corners",
    """SELECT img, yi, xi FROM {rasters} r JOIN (SELECT img, max(yi) + 1 AS h FROM {rasters} GROUP BY img) s USING (img)
       WHERE yi <= h - 5 AND xi <= 40 - 5""",
)
def q10(i):
    heights = i.rasters.groupBy("img").agg((F.max("yi") + 1).alias("h_"))
    images = lookup_join(i.rasters, heights, ["img"])
    return sampling.patch_corners(images, F.col("h_"), WIDTH, 5).select("img", "yi", "xi")

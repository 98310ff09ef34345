"""Model queries: forest over pixels, tile scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from gridloom.catalog.base import BANDS, BURN, CHUNK, MAXY, SCALE, query, rounded
from gridloom.catalog.grids import SHIFTED, shifted_windows
from gridloom.functions.vectors import sigmoid
from gridloom.operators import metrics, models, polygons
from gridloom.plans import landcover
from gridloom.session import cut


def _forest_scores(i):
    """Scores per split and direction of a forest that is fitted on the training tiles only.

    Target: pixels under more polygons of any label than the average covered pixel.
    """
    burned = polygons.burned_pixels(i.polygons, 0.0, MAXY, SCALE, ["fid"], tile=16)
    # read for the average and for the labels of both directions
    depth = cut(burned.groupBy("yi", "xi").agg(F.count(F.lit(1)).alias("depth")))
    cube = cut(i.cube.select("yi", "xi", "t", *BANDS))
    usual = depth.agg(F.avg("depth")).scalar()
    hits = depth.select("yi", "xi", F.when(F.col("depth") > usual, 1.0).otherwise(0.0).alias("hit"))
    tile = (F.floor(F.col("yi") / 8) * 5 + F.floor(F.col("xi") / 8)).cast("int")
    split = F.when(F.col("tile_id") % 5 == 0, "test").when(F.col("tile_id") % 5 == 1, "validate").otherwise("train")

    def labelled(reverse: bool):
        rows = models.pixel_features(cube, ["yi", "xi"], BANDS, "t", 7, reverse=reverse)
        rows = rows.join(hits, ["yi", "xi"], "left").fillna({"hit": 0.0})
        return rows.withColumn("tile_id", tile).withColumn("split", split)

    forward = cut(labelled(False))  # fitting runs many jobs over these rows and scoring reads them again
    model = models.fit_forest(forward.where("split = 'train'"), "hit")
    scored = models.apply_forest(model, forward.withColumn("direction", F.lit("forward"))).unionByName(
        models.apply_forest(
            model, labelled(True).where("split = 'test'").withColumn("direction", F.lit("reversed"))
        )
    )
    scored = cut(scored.drop("features"))  # each pixel goes down all trees, and is read by both scores
    image = ["split", "direction", "tile_id"]
    flat = metrics.binary_scores(scored, "prediction", "hit", by=["split", "direction"])
    likeness = (
        metrics.ssim(scored, image, "prediction", "hit", tile=8)
        .groupBy("split", "direction")
        .agg(F.avg("ssim").alias("ssim"))
    )
    return flat.join(likeness, ["split", "direction"], "left")


@query("m1_pixel_forest")
def m1(i):
    """Fit on pixel histories of the training tiles; score all splits, the test tiles reversed as well."""
    return rounded(_forest_scores(i), "accuracy", "jaccard", "precision", "recall", "ssim")


@query(
    "m1_forest_checks",
    """
SELECT CASE (yi // 8 * 5 + xi // 8) % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validate' ELSE 'train' END AS split,
       d.direction, count(*) AS n, count(*) FILTER (hit) AS positives, true AS cells_add_up, true AS in_range
FROM (SELECT p.yi, p.xi, coalesce(deep.n > usual, false) AS hit
      FROM (SELECT DISTINCT yi, xi FROM {cube}) p
      LEFT JOIN deep USING (yi, xi) CROSS JOIN (SELECT avg(n) AS usual FROM deep))
CROSS JOIN (VALUES ('forward'), ('reversed')) d(direction)
WHERE d.direction = 'forward' OR (yi // 8 * 5 + xi // 8) % 5 = 0
GROUP BY 1, 2""",
    BURN + ", deep AS (SELECT yi, xi, count(DISTINCT fid) AS n FROM burn GROUP BY 1, 2)",
)
def m1_checks(i):
    """What SQL can say about the scores: rows and positives, adding up, ranges."""
    s = _forest_scores(i)
    n = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    share = [F.col(c).between(0, 1) for c in ("accuracy", "jaccard", "precision", "recall")]
    near = F.coalesce(F.col("ssim").between(-1.000001, 1.000001), F.lit(True))
    return s.select(
        "split", "direction", n.alias("n"), (F.col("tp") + F.col("fn")).alias("positives"),
        (F.col("tp") + F.col("tn") == F.round(F.col("accuracy") * n)).alias("cells_add_up"),
        (share[0] & share[1] & share[2] & share[3] & near).alias("in_range"),
    )


def load_difference():
    """A stand-in for a trained model: three times band 1 minus band 0."""
    def model(blocks: np.ndarray) -> np.ndarray:
        return (blocks[:, 1:2] - blocks[:, 0:1]) * 3.0

    return model


@query(
    "m3_score_and_mosaic",
    f"""
SELECT w.t, 0 AS band, y.yi, y.xi, count(*) AS n,
       round(avg(1 / (1 + exp(-CAST(3 * (coalesce(c.b5, -1) - coalesce(c.b1, -1)) AS FLOAT)))), 5) AS score
FROM (SELECT p.*, CAST(s AS INT) AS t FROM pads p, generate_series(0, 6) g(s)) w
JOIN (SELECT DISTINCT yi, xi FROM {{observations}}) y
  ON y.yi >= row0 AND y.yi < row0 + 4 - pad_top - pad_bottom AND y.xi >= col0 AND y.xi < col0 + 4 - pad_left - pad_right
LEFT JOIN {{cube}} c ON c.yi = y.yi AND c.xi = y.xi AND c.t = w.t
GROUP BY w.t, y.yi, y.xi""",
    SHIFTED,
)
def m3(i):
    windows = shifted_windows(i).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(6))))
    out = landcover.score_and_mosaic(
        windows, i.cube.select("yi", "xi", "t", "b1", "b5"), ["b1", "b5"], CHUNK, SCALE,
        F.lit(0.0), F.lit(MAXY), load_difference, lambda x: sigmoid(x.cast("double")),
    )
    return out.select("t", "band", "yi", "xi", "n", F.round("score", 5).alias("score"))

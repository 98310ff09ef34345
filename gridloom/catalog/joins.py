"""Join queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.temporal import DENSE
from gridloom.catalog.base import BURN, G, HITS, MAXY, SCALE, query, r6, rounded, s6
from gridloom.catalog.grids import chunks_of
from gridloom.operators import composites, pairs, polygons, temporal
from gridloom.sources import cubes


@query("j1_chunks_meeting_polygons", "SELECT chunk_id, count(DISTINCT fid) AS n FROM hits GROUP BY chunk_id", HITS)
def j1(i):
    cells = polygons.polygon_cells(i.polygons, F.lit(0.0), F.lit(MAXY), G, G)
    per_cell = cells.groupBy("r", "c").agg(F.count(F.lit(1)).alias("n"))
    return chunks_of(i).join(per_cell, ["r", "c"]).select("chunk_id", "n")


@query("j2_chunk_dates", "SELECT DISTINCT chunk_id, yr FROM hits", HITS)
def j2(i):
    return polygons.chunk_samples(chunks_of(i), i.polygons, i.extent, G, G, "yr").select("chunk_id", "yr")


@query(
    "j2_chunk_all_times",
    "SELECT k.chunk_id, CAST(t AS INT) AS t FROM (SELECT DISTINCT chunk_id FROM hits) k, generate_series(0, 3) g(t)",
    HITS,
)
def j2b(i):
    steps = temporal.anchor_steps(7, (2, 2))
    return polygons.chunk_samples(
        chunks_of(i), i.polygons, i.extent, G, G, time_indices=steps
    ).select("chunk_id", "t")


@query("u3_distinct_dates", "SELECT chunk_id, count(DISTINCT yr) AS dates FROM hits GROUP BY chunk_id", HITS)
def u3(i):
    samples = polygons.chunk_samples(chunks_of(i), i.polygons, i.extent, G, G, "yr")
    return samples.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("dates"))


FIRST = """
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY seq, src, probability) AS rn
           FROM {cloud_prob}) WHERE rn = 1)"""
ORDER = [("seq", "asc"), ("src", "asc"), ("probability", "asc")]


@query(
    "j3_first_match",
    """SELECT s.scene_id, s.cloud_pct, f.seq AS m_seq, f.src AS m_src, f.probability AS m_probability
       FROM {scenes} s JOIN firsts f ON f.scene_id = s.scene_id""",
    FIRST,
)
def j3(i):
    primary = i.scenes.select("scene_id", "cloud_pct")
    return composites.save_first(primary, i.cloud_prob, "scene_id", ORDER)


@query(
    "j4_index_join_add_bands",
    """SELECT s.scene_id, s.sensor, f.probability > 65 AS is_cloud, f.probability AS b_probability
       FROM {scenes} s JOIN firsts f ON f.scene_id = s.scene_id""",
    FIRST,
)
def j4(i):
    joined = composites.save_first(i.scenes.select("scene_id", "sensor"), i.cloud_prob, "scene_id", ORDER, "b_")
    return joined.select("scene_id", "sensor", (F.col("b_probability") > 65).alias("is_cloud"), "b_probability")


YEARS = range(1995, 2002)


@query(
    "j5_stack_rasters",
    "SELECT p.yi, p.xi, p.landcover, "
    + ", ".join(f'{s6(f"max(CASE WHEN c.yr = {y} THEN c.{b} END)")} AS "{y}_{b}"' for y in YEARS for b in ("b1", "b4"))
    + """
FROM (SELECT CAST(floor(p_partkey / 40e0) AS INT) AS yi, CAST(p_partkey % 40 AS INT) AS xi, p_size AS landcover
      FROM {part}) p LEFT JOIN {cube} c ON c.yi = p.yi AND c.xi = p.xi GROUP BY 1, 2, 3""",
)
def j5(i):
    """Land cover with the bands of every year stacked behind it."""
    landcover = i.part.select(
        F.floor(F.col("p_partkey") / 40).cast("int").alias("yi"),
        (F.col("p_partkey") % 40).cast("int").alias("xi"),
        F.col("p_size").alias("landcover"),
    )
    years = composites.stack_periods(i.cube, ["yi", "xi"], "yr", list(YEARS), ["b1", "b4"])
    stacked = composites.add_bands(landcover, years, ["yi", "xi"])
    return rounded(stacked, *[c for c in stacked.columns if "_b" in c])


def label_steps(i):
    """Burned pixels per time step, as a table of ones."""
    burned = polygons.burned_pixels(i.polygons, 0.0, MAXY, SCALE, ["yr"], tile=16)
    return burned.select("yi", "xi", (F.col("yr") - 1995).alias("t"), F.lit(1.0).alias("label"))


@query(
    "j6_samples_imagery_labels",
    f"""
SELECT s.split, s.tile_id, s.t, CAST(c.t - s.t + 1 AS INT) AS k, count(*) AS n, {s6('avg(c.b4)')} AS b4,
       CAST(count(b.yi) AS DOUBLE) AS labelled
FROM {{splits}} s JOIN dense c ON c.tile_id = s.tile_id AND c.t BETWEEN s.t - 1 AND s.t
LEFT JOIN (SELECT DISTINCT yi, xi, yr - 1995 AS t FROM burn) b ON b.yi = c.yi AND b.xi = c.xi AND b.t = s.t - 1
WHERE s.t >= 1 GROUP BY 1, 2, 3, 4""",
    BURN + "," + DENSE,
)
def j6(i):
    joined = temporal.windows_with_labels(
        i.splits, i.cube, label_steps(i), "tile_id", ["yi", "xi"], ["b4"], "label", 7
    )
    return joined.groupBy("split", "tile_id", "t", "k").agg(
        F.count(F.lit(1)).alias("n"), r6(F.avg("b4")).alias("b4"), F.sum("label").alias("labelled")
    )


@query(
    "j7_forward_vs_reversed",
    f"""
SELECT img, t, {s6('sum(abs(x - y))')} AS l1 FROM (
  SELECT f.img, f.t, unnest(CAST(f.emb AS DOUBLE[])) AS x, unnest(CAST(r.emb AS DOUBLE[])) AS y
  FROM runs f JOIN (SELECT img, t, list_reverse(emb) AS emb FROM runs) r ON r.img = f.img AND r.t = 1 - f.t)
GROUP BY img, t""",
    """runs AS (SELECT CAST(floor(vec_id / 2e0) AS BIGINT) AS img, CAST(vec_id % 2 AS INT) AS t, embedding AS emb
                FROM {embeddings})""",
)
def j7(i):
    runs = i.embeddings.select(
        F.floor(F.col("vec_id") / 2).alias("img"), (F.col("vec_id") % 2).cast("int").alias("t"),
        F.col("embedding").alias("emb"),
    )
    reverse = runs.withColumn("emb", F.reverse("emb"))
    matched = pairs.match_reversed(runs, reverse, ["img"])
    return pairs.pair_distances(matched, "emb", "emb_rev").select("img", "t", r6("l1").alias("l1"))


@query(
    "j8_predictions_by_position",
    f"""SELECT o_orderkey, f.label, f.yr FROM {{orders}} o
        JOIN (SELECT *, o_position FROM (SELECT fid AS o_position, * FROM {{features}})) f
          ON f.o_position = (o.o_orderkey * 7) % (SELECT count(*) FROM {{features}})""",
)
def j8(i):
    n = i.features.agg(F.count(F.lit(1))).scalar()
    named = i.orders.select(
        "o_orderkey",
        F.concat(((F.col("o_orderkey") * 7) % n).cast("string"), F.lit("_t0.pt")).alias("file"),
    )
    boxes = i.features.select(F.col("fid").alias("position"), "label", "yr", *_box())
    placed = cubes.georeference(named, boxes, "position", "file", 4, 4)
    return placed.select("o_orderkey", "label", "yr")


def _box():
    return [
        F.col("x0").alias("minx"), F.col("y0").alias("miny"),
        (F.col("x0") + F.col("w")).alias("maxx"), (F.col("y0") + F.col("h")).alias("maxy"),
    ]


MODELS = """
pairs AS (
  SELECT a.model AS model_a, b.model AS model_b, sum(abs(a.value - b.value)) AS l1,
         sqrt(sum((a.value - b.value) * (a.value - b.value))) AS l2,
         sum(a.value * b.value) / (sqrt(sum(a.value * a.value)) * sqrt(sum(b.value * b.value))) AS cosine
  FROM {params} a JOIN {params} b ON a.name = b.name AND a.pos = b.pos GROUP BY 1, 2)"""


@query(
    "j9_model_pairs",
    f"""SELECT model_a, model_b, {s6('l1', 4)} AS l1, {s6('l2')} AS l2, {s6('cosine')} AS cosine FROM pairs""",
    MODELS,
)
def j9(i):
    return pairs.model_matrix(i.params).select(
        "model_a", "model_b", r6("l1", 4).alias("l1"), r6("l2").alias("l2"), r6("cosine").alias("cosine")
    )


@query(
    "j10_imagery_with_labels",
    f"""
SELECT p.yi, p.xi, p.tdx, CAST(c.t - p.tdx + 1 AS INT) AS k, {s6('c.b4')} AS b4,
       CASE WHEN b.yi IS NULL THEN 0e0 ELSE 1e0 END AS label
FROM (SELECT DISTINCT yi, xi, CAST(g.t AS INT) AS tdx FROM {{cube}}, generate_series(0, 6) g(t)) p
JOIN dense c ON c.yi = p.yi AND c.xi = p.xi AND c.t BETWEEN p.tdx - 1 AND p.tdx + 1
LEFT JOIN (SELECT DISTINCT yi, xi, yr - 1995 AS t FROM burn) b ON b.yi = p.yi AND b.xi = p.xi AND b.t = p.tdx
WHERE p.tdx >= 1 AND p.tdx + 2 <= 7""",
    BURN + "," + DENSE,
)
def j10(i):
    places = i.cube.select("yi", "xi").distinct()
    anchors = places.withColumn("tdx", F.explode(F.sequence(F.lit(0), F.lit(6))))
    imagery = temporal.asymmetric_windows(anchors, i.cube, ["yi", "xi"], ["yi", "xi"], ["b4"], (1, 2), 7)
    labels = label_steps(i).withColumnRenamed("t", "tdx")
    joined = cubes.with_labels(imagery, labels, ["yi", "xi", "tdx"], "label")
    return joined.select("yi", "xi", "tdx", "k", r6("b4").alias("b4"), F.coalesce("label", F.lit(0.0)).alias("label"))

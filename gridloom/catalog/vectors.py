"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.catalog.base import query, r6, rounded, s6
from gridloom.functions import vectors as V
from gridloom.operators import models, pairs

LONG = """
el AS (SELECT vec_id, label, unnest(generate_series(0, 63)) AS idx, unnest(CAST(emb_a AS DOUBLE[])) AS a,
              unnest(CAST(emb_b AS DOUBLE[])) AS b FROM {embedding_pairs})"""


@query(
    "f8_vector_distances",
    f"""SELECT vec_id, {s6('sum(abs(a - b))')} AS l1, {s6('sqrt(sum((a - b) * (a - b)))')} AS l2,
               {s6('sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b)))')} AS cosine FROM el GROUP BY vec_id""",
    LONG,
)
def f8(i):
    out = pairs.pair_distances(i.embedding_pairs, "emb_a", "emb_b")
    return rounded(out.select("vec_id", "l1", "l2", "cosine"), "l1", "l2", "cosine")


@query(
    "f9_sub_ranges",
    f"""SELECT vec_id, {s6('sum(CASE WHEN idx < 48 THEN abs(a - b) END)')} AS space_l1,
               {s6('sum(CASE WHEN idx >= 48 THEN abs(a - b) END)')} AS time_l1 FROM el GROUP BY vec_id""",
    LONG,
)
def f9(i):
    a, b = F.col("emb_a"), F.col("emb_b")
    part = lambda lo, hi: V.l1(V.sub_range(a, lo, hi), V.sub_range(b, lo, hi))
    return i.embedding_pairs.select(
        "vec_id", r6(part(0, 48)).alias("space_l1"), r6(part(48, 64)).alias("time_l1")
    )


CHANGES = """
el AS (SELECT vec_id, idx, f0, f1, r0, r1, f1 - f0 AS fwd, r1 - r0 AS rev, f0 - r0 AS at0, f1 - r1 AS at1 FROM (
  SELECT vec_id, unnest(generate_series(0, 63)) AS idx, unnest(CAST(emb_a AS DOUBLE[])) AS f0,
         unnest(CAST(emb_b AS DOUBLE[])) AS f1, unnest(CAST(list_reverse(emb_a) AS DOUBLE[])) AS r0,
         unnest(CAST(list_reverse(emb_b) AS DOUBLE[])) AS r1 FROM {embedding_pairs})),
rg AS (SELECT min(fwd) AS flo, max(fwd) AS fhi, min(at0) AS alo, max(at0) AS ahi FROM el)"""


def changes(i):
    runs = i.embedding_pairs.withColumn("rev_a", F.reverse("emb_a")).withColumn("rev_b", F.reverse("emb_b"))
    return pairs.embedding_changes(runs, "emb_a", "emb_b", "rev_a", "rev_b", ["vec_id", "label"])


@query(
    "f10_embedding_changes",
    f"""SELECT vec_id, CAST(idx AS INT) AS idx, {s6('(fwd - flo) / (fhi - flo)')} AS fwd, {s6('(rev - flo) / (fhi - flo)')} AS rev,
               {s6('(at0 - alo) / (ahi - alo)')} AS at0, {s6('(at1 - alo) / (ahi - alo)')} AS at1,
               {s6('(fwd - flo) / (fhi - flo) - (rev - flo) / (fhi - flo)')} AS second FROM el, rg""",
    CHANGES,
)
def f10(i):
    names = ["fwd", "rev", "at0", "at1", "second"]
    rows = changes(i).select("vec_id", F.posexplode(F.arrays_zip(*names)).alias("idx", "z"))
    return rows.select("vec_id", "idx", *[r6(F.col("z")[n]).alias(n) for n in names])


@query(
    "f11_long_differences",
    f"SELECT vec_id, label, CAST(idx AS INT) AS idx, {s6('b - a')} AS value FROM el",
    LONG,
)
def f11(i):
    d = i.embedding_pairs.withColumn("d", V.difference(F.col("emb_b"), F.col("emb_a")))
    return rounded(pairs.long_form(d, "d", ["vec_id", "label"]), "value")


@query(
    "f14_normalise",
    f"SELECT vec_id, CAST(idx AS INT) AS idx, {s6('a / sqrt(sum(a * a) OVER (PARTITION BY vec_id))')} AS value FROM el",
    LONG,
)
def f14(i):
    n = i.embedding_pairs.withColumn("n", V.normalise(F.col("emb_a")))
    return rounded(pairs.long_form(n, "n", ["vec_id"]), "value")


@query(
    "u2_concatenate_sets",
    f"""SELECT vec_id, 'a' AS part, CAST(64 AS INT) AS dims, {s6('sum(a)')} AS total FROM el GROUP BY vec_id
        UNION ALL SELECT vec_id, 'b', 64, {s6('sum(b)')} FROM el GROUP BY vec_id
        UNION ALL SELECT vec_id, 'ab', 128, {s6('sum(a) + sum(b)')} FROM el GROUP BY vec_id""",
    LONG,
)
def u2(i):
    p = i.embedding_pairs
    rows = p.select("vec_id", F.lit("a").alias("part"), F.col("emb_a").alias("v")).unionByName(
        p.select("vec_id", F.lit("b").alias("part"), F.col("emb_b").alias("v"))
    )
    wide = p.select("vec_id", F.lit("ab").alias("part"), F.concat("emb_a", "emb_b").alias("v"))
    return rows.unionByName(wide).select(
        "vec_id", "part", F.size("v").alias("dims"), r6(V.total(F.col("v"))).alias("total")
    )


NCE = """
v AS (SELECT vec_id, CAST(label % 3 AS INT) AS step, CAST(emb_a AS DOUBLE[]) AS h, CAST(emb_b AS DOUBLE[]) AS p,
             CAST(list_reverse(emb_a) AS DOUBLE[]) AS n1, CAST(list_reverse(emb_b) AS DOUBLE[]) AS n2 FROM {embedding_pairs}),
sim AS (SELECT vec_id, step,
    list_inner_product(h, p) / sqrt(list_inner_product(h, h) * list_inner_product(p, p)) / 0.1e0 AS pos,
    list_inner_product(h, n1) / sqrt(list_inner_product(h, h) * list_inner_product(n1, n1)) / 0.1e0 AS s1,
    list_inner_product(h, n2) / sqrt(list_inner_product(h, h) * list_inner_product(n2, n2)) / 0.1e0 AS s2 FROM v),
neg AS (SELECT step, s1 AS s FROM sim UNION ALL SELECT step, s2 FROM sim)"""


def _summary(where: str, step: str) -> str:
    return f"""SELECT {step} AS step, {s6('avg(ln(exp(pos) + exp(s1) + exp(s2)) - pos)')} AS loss, {s6('max(pos)')} AS max_pos_sim,
      {s6('min(pos)')} AS min_pos_sim, {s6('avg(pos)')} AS mean_pos_sim, {s6('stddev_samp(pos)')} AS stdv_pos_sim,
      (SELECT {s6('max(s)')} FROM neg {where}) AS max_neg_sim, (SELECT {s6('min(s)')} FROM neg {where}) AS min_neg_sim,
      (SELECT {s6('avg(s)')} FROM neg {where}) AS mean_neg_sim, (SELECT {s6('stddev_samp(s)')} FROM neg {where}) AS stdv_neg_sim
      FROM sim"""


def _contrasted(i):
    negatives = F.array(F.reverse("emb_a"), F.reverse("emb_b"))
    rows = i.embedding_pairs.withColumn("step", (F.col("label") % 3).cast("int")).withColumn("negatives", negatives)
    return pairs.contrastive_scores(rows, "emb_a", "emb_b", "negatives", 0.1)


@query(
    "a23_contrastive_summary",
    _summary("WHERE neg.step = sim.step", "sim.step") + " GROUP BY sim.step UNION ALL " + _summary("", "-1"),
    NCE,
)
def a23(i):
    scored = _contrasted(i)
    per_step = pairs.contrastive_summary(scored, "step")
    overall = pairs.contrastive_summary(scored).withColumn("step", F.lit(-1))
    both = per_step.unionByName(overall)
    return rounded(both, *[c for c in both.columns if c != "step"])


@query(
    "a23_contrastive_steps",
    "SELECT " + ", ".join(
        f"(SELECT {s6('avg(pos)')} FROM sim WHERE step = {k}) AS pos_sim_{k + 1}, "
        f"(SELECT {s6('avg(s)')} FROM neg WHERE step = {k}) AS neg_sim_{3 - k}" for k in range(3)
    ),
    NCE,
)
def a23_steps(i):
    out = pairs.contrastive_steps(_contrasted(i), "step", 3)
    return rounded(out, *out.columns)


@query("m2_projection")
def m2(i):
    model = models.fit_projection(i.embedding_pairs, "emb_a")
    first = models.apply_projection(model, i.embedding_pairs.select("vec_id", "emb_a"), "emb_a")
    second = models.apply_projection(model, i.embedding_pairs.select("vec_id", "emb_b"), "emb_b")
    named = lambda df, name: df.select(
        "vec_id", F.lit(name).alias("part"),
        *[r6(F.get("projection", F.lit(k))).alias(f"pc{k + 1}") for k in range(2)],
    )
    return named(first, "fitted").unionByName(named(second, "applied"))


@query(
    "m2_projection_checks",
    f"""
SELECT count(*) AS n, {s6('(SELECT sum(v) FROM (SELECT var_samp(x) AS v FROM long GROUP BY pos))', 4)} AS total_variance,
       true AS ordered, true AS within_total, true AS orthogonal FROM {{embedding_pairs}}""",
    """long AS (SELECT unnest(CAST(emb_a AS DOUBLE[])) AS x, unnest(generate_series(0, 63)) AS pos FROM {embedding_pairs})""",
)
def m2_checks(i):
    """What SQL can say about the projection: rows, total variance, order and size of the components."""
    pairs = i.embedding_pairs.select("vec_id", "emb_a")
    model = models.fit_projection(pairs, "emb_a")
    projected = models.apply_projection(model, pairs, "emb_a").select(
        F.get("projection", F.lit(0)).alias("p1"), F.get("projection", F.lit(1)).alias("p2")
    )
    spread = projected.agg(
        F.count(F.lit(1)).alias("n"), F.var_samp("p1").alias("v1"), F.var_samp("p2").alias("v2"),
        F.covar_samp("p1", "p2").alias("v12"),
    )
    long = pairs.select(F.posexplode(F.col("emb_a").cast("array<double>")).alias("pos", "x"))
    total = long.groupBy("pos").agg(F.var_samp("x").alias("v")).agg(F.sum("v")).scalar()
    return spread.withColumn("total", total).select(
        "n",
        r6("total", 4).alias("total_variance"),
        (F.col("v1") >= F.col("v2")).alias("ordered"),
        (F.col("v1") + F.col("v2") <= F.col("total") + 1e-6).alias("within_total"),
        (F.abs("v12") <= 1e-6 * F.col("total")).alias("orthogonal"),
    )

"""Comparing vectors: embedding pairs, model parameters, contrastive scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gridloom.functions import vectors as V


def pair_distances(df: DataFrame, a: str, b: str) -> DataFrame:
    """L1, L2 and cosine between the two vectors of each row."""
    va, vb = F.col(a), F.col(b)
    return df.select(
        "*", V.l1(va, vb).alias("l1"), V.l2(va, vb).alias("l2"), V.cosine(va, vb).alias("cosine")
    )


def match_reversed(
    forward: DataFrame, reverse: DataFrame, place: list[str], time: str = "t", frames: int = 2,
    vector: str = "emb",
) -> DataFrame:
    """Pair forward vectors with those of the time-reversed run.

    Frame ``t`` of the reversed run shows step ``frames - 1 - t``, so its index is swapped
    before the equality join.
    """
    swapped = reverse.select(
        *place, (F.lit(frames - 1) - F.col(time)).cast("int").alias(time),
        F.col(vector).alias(f"{vector}_rev"),
    )
    return forward.join(swapped, [*place, time])


def model_matrix(params: DataFrame, model: str = "model") -> DataFrame:
    """L1, L2 and cosine of every ordered pair of models over aligned parameters, with the diagonal.

    The models of one parameter are packed into one row, so a parameter crosses the shuffle once and
    meets nothing else there.  A packed row gives the products of its models in place, and they are summed
    on the map side: what is left to shuffle is a matrix of models by models for each task.  Of
    repeated rows of one parameter and model the largest value counts; missing values take part in no pair.
    """
    held = params.select("name", "pos", F.col(model).alias("model"), F.col("value").cast("double").alias("value"))
    rows = held.dropna(subset=["model", "value"]).groupBy("name", "pos").agg(
        F.sort_array(F.collect_list(F.struct("model", "value"))).alias("all_"))
    last = F.filter("all_", lambda x, i: ~F.get("all_", i + 1)["model"].eqNullSafe(x["model"]))
    sides = lambda a, b: F.struct(
        a["model"].alias("model_a"), b["model"].alias("model_b"), a["value"].alias("va"), b["value"].alias("vb"))
    products = F.flatten(F.transform(
        "r", lambda a: F.transform(F.filter("r", lambda b: a["model"] <= b["model"]), lambda b: sides(a, b))))
    va, vb = F.col("va"), F.col("vb")
    sums = rows.select(last.alias("r")).select(F.inline(products)).groupBy("model_a", "model_b").agg(
        F.sum(F.abs(va - vb)).alias("l1"),
        F.sqrt(F.sum((va - vb) * (va - vb))).alias("l2"),
        F.sum(va * vb).alias("ab_"),
        F.sqrt(F.sum(va * va)).alias("na_"),
        F.sqrt(F.sum(vb * vb)).alias("nb_"),
    )
    cosine = F.col("ab_") / (F.greatest("na_", F.lit(1e-8)) * F.greatest("nb_", F.lit(1e-8)))
    half = sums.select("model_a", "model_b", "l1", "l2", cosine.alias("cosine"))
    return mirror(half, ["l1", "l2", "cosine"])


def model_distances(params: DataFrame, model: str = "model") -> DataFrame:
    """L1, L2 and cosine between all unordered pairs of models, over aligned parameters."""
    return model_matrix(params, model).where(F.col("model_a") < F.col("model_b"))


def mirror(pairs: DataFrame, values: list[str]) -> DataFrame:
    """Both orders of each pair; a model with itself stays one row."""
    a, b = F.col("model_a"), F.col("model_b")
    turned = F.struct(b.alias("model_a"), a.alias("model_b"))
    both = F.explode(F.when(a == b, F.array(F.struct(a, b))).otherwise(F.array(F.struct(a, b), turned)))
    return pairs.select(both.alias("m_"), *values).select("m_.*", *values)


def embedding_changes(
    df: DataFrame, f0: str, f1: str, r0: str, r1: str, id_cols: list[str]
) -> DataFrame:
    """Change vectors between two steps of the forward and the reversed run, long form.

    ``fwd`` and ``rev`` are step 1 minus step 0; ``at0`` and ``at1`` forward minus reversed;
    ``second`` is the scaled ``fwd`` minus the scaled ``rev``.  ``fwd, rev`` share the range
    of ``fwd`` and ``at0, at1`` the range of ``at0``.
    """
    d = V.difference
    wide = df.select(
        *id_cols,
        d(F.col(f1), F.col(f0)).alias("fwd"),
        d(F.col(r1), F.col(r0)).alias("rev"),
        d(F.col(f0), F.col(r0)).alias("at0"),
        d(F.col(f1), F.col(r1)).alias("at1"),
    )
    ranges = wide.agg(
        F.struct(
            *[
                F.struct(
                    F.min(F.array_min(c)).alias("lo"), F.max(F.array_max(c)).alias("hi")
                ).alias(c)
                for c in ("fwd", "at0")
            ]
        )
    ).scalar()
    ranged = wide.withColumn("r_", ranges)

    def scaled(column: str, by: str) -> Column:
        lo, hi = F.col("r_")[by]["lo"], F.col("r_")[by]["hi"]
        return F.transform(F.col(column), lambda x: F.try_divide(x - lo, hi - lo))

    out = ranged.select(
        *id_cols,
        scaled("fwd", "fwd").alias("fwd"),
        scaled("rev", "fwd").alias("rev"),
        scaled("at0", "at0").alias("at0"),
        scaled("at1", "at0").alias("at1"),
    )
    return out.withColumn("second", d(F.col("fwd"), F.col("rev")))


def long_form(df: DataFrame, vector: str, id_cols: list[str]) -> DataFrame:
    """One row per vector element."""
    return df.select(*id_cols, F.posexplode(vector).alias("idx", "value"))


def contrastive_scores(
    df: DataFrame, anchor: str, positive: str, negatives: str, temperature: float
) -> DataFrame:
    """Per row: similarity to the positive, to each negative, and the contrastive loss.

    ``negatives`` is an array of vectors that belongs to the row; logits are shifted by their
    maximum before the exponential.
    """
    tau = F.lit(float(temperature))
    normed = df.withColumn("h_", V.normalise(F.col(anchor)))
    scored = normed.withColumn("pos_sim", V.dot(F.col("h_"), V.normalise(F.col(positive))) / tau)
    scored = scored.withColumn(
        "neg_sims", F.transform(F.col(negatives), lambda v: V.dot(F.col("h_"), V.normalise(v)) / tau)
    )
    logits = F.concat(F.array("pos_sim"), F.col("neg_sims"))
    return scored.withColumn("loss", V.log_sum_exp(logits) - F.col("pos_sim")).drop("h_")


def contrastive_summary(
    scored: DataFrame, step: str | None = None, scaling: float | None = None
) -> DataFrame:
    """Loss and spread of the similarities, overall or per prediction step.

    Negative similarities are folded to sums per row first, so nothing is multiplied out.
    """
    negs = F.col("neg_sims")
    rows = scored.select(
        *([step] if step else []),
        "pos_sim",
        "loss",
        F.array_max(negs).alias("mx_"),
        F.array_min(negs).alias("mn_"),
        F.size(negs).alias("k_"),
        V.total(negs).alias("s_"),
        V.dot(negs, negs).alias("ss_"),
    )
    grouped = rows.groupBy(*([step] if step else []))
    mean = F.sum("s_") / F.sum("k_")
    spread = F.sqrt(
        F.greatest(F.sum("ss_") - F.sum("s_") * mean, F.lit(0.0)) / (F.sum("k_") - 1)
    )
    loss = F.avg("loss") * (scaling if scaling is not None else 1.0)
    return grouped.agg(
        loss.alias("loss"),
        F.max("pos_sim").alias("max_pos_sim"),
        F.min("pos_sim").alias("min_pos_sim"),
        F.avg("pos_sim").alias("mean_pos_sim"),
        F.stddev_samp("pos_sim").alias("stdv_pos_sim"),
        F.max("mx_").alias("max_neg_sim"),
        F.min("mn_").alias("min_neg_sim"),
        mean.alias("mean_neg_sim"),
        spread.alias("stdv_neg_sim"),
    )


def contrastive_steps(scored: DataFrame, step: str, steps: int) -> DataFrame:
    """One row with the mean similarity of each prediction step 0 to ``steps - 1``.

    Positives are named forward, ``pos_sim_1`` for step 0; negatives backward, ``neg_sim_1`` for the
    last step, because their steps count down to the anchor.  A step without rows gives NULL.
    """
    negs = F.col("neg_sims")
    at = lambda k, c: F.when(F.col(step) == k, c)
    means = {}
    for k in range(steps):
        means[f"pos_sim_{k + 1}"] = F.avg(at(k, F.col("pos_sim")))
        size = F.sum(at(k, F.size(negs)))
        means[f"neg_sim_{steps - k}"] = F.sum(at(k, V.total(negs))) / F.nullif(size, F.lit(0))
    return scored.agg(*[c.alias(name) for name, c in means.items()])


def drop_invalid(df: DataFrame, columns: list[str]) -> DataFrame:
    """Drop a row from all aligned columns when any derived value is missing or NaN."""
    return df.dropna(subset=columns)


def misaligned(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows of two tables that should agree but do not; empty when they are aligned."""
    left = a.select(*keys, F.col(value).alias("left_value"))
    right = b.select(*keys, F.col(value).alias("right_value"))
    return left.join(right, keys, "full_outer").where(
        ~F.col("left_value").eqNullSafe(F.col("right_value"))
    )

"""Paths for groups too large for one task give the same rows as the ordinary paths."""

import hashlib
import random
import re
import statistics

from pyspark.sql import functions as F

from gridloom.operators import composites, ranks


def observations(spark):
    """One pixel holds a third of the rows; values repeat, some are missing."""
    rng = random.Random(5)
    rows = []
    for n in range(3000):
        pixel = 0 if n % 3 == 0 else rng.randrange(1, 40)
        a = None if rng.random() < 0.05 else rng.choice([0.1, 0.2, 0.5, rng.random()])
        rows.append((pixel, n, a, rng.randrange(50) / 7))
    return spark.createDataFrame(rows, "pixel int, n int, a double, b double"), rows


def test_median_of_hot_groups(spark):
    df, rows = observations(spark)
    got = {
        r.pixel: (r.n_obs, r.a, r.b)
        for r in ranks.exact_median(df, ["pixel"], ["a", "b"], n_col="n_obs", spread=True).collect()
    }
    plain = {
        r.pixel: (r.n_obs, r.a, r.b)
        for r in ranks.exact_median(df, ["pixel"], ["a", "b"], n_col="n_obs").collect()
    }
    for pixel in {r[0] for r in rows}:
        a = [r[2] for r in rows if r[0] == pixel and r[2] is not None]
        b = [r[3] for r in rows if r[0] == pixel]
        expected = (len(b), statistics.median(a), statistics.median(b))
        assert got[pixel][0] == plain[pixel][0] == expected[0]
        for k in (1, 2):
            assert abs(got[pixel][k] - expected[k]) < 1e-12
            assert abs(plain[pixel][k] - expected[k]) < 1e-12


def test_median_of_a_group_without_values(spark):
    df = spark.createDataFrame([(1, None)] * 5 + [(2, 1.0)] * 2, "pixel int, a double")
    got = {r.pixel: r.a for r in ranks.exact_median(df, ["pixel"], ["a"], spread=True).collect()}
    assert got == {1: None, 2: 1.0}


def test_medoid_of_hot_groups(spark):
    df, _ = observations(spark)
    plain = composites.medoid_composite(df, ["pixel"], ["a", "b"], ["n"])
    hot = composites.medoid_composite(df, ["pixel"], ["a", "b"], ["n"], spread=True)
    assert sorted(map(tuple, plain.select("pixel", "n").collect())) == sorted(
        map(tuple, hot.select("pixel", "n").collect())
    )


def test_top_row_puts_missing_values_last(spark):
    df = spark.createDataFrame(
        [(1, None, "x"), (1, 3.0, "y"), (1, 5.0, "z"), (2, None, "w")], "k int, v double, s string"
    )
    for direction, first in (("asc", "y"), ("desc", "z")):
        got = {r.k: r.s for r in ranks.top_row(df, ["k"], [("v", direction)]).collect()}
        assert got == {1: first, 2: "w"}


def digest(key, seed, epoch):
    return hashlib.md5(f"{key}:{seed}:{epoch}".encode()).hexdigest()


def test_random_order_is_exact(spark):
    df = spark.range(2000)
    for digits in (1, 3):
        got = {r.id: r["rank"] for r in ranks.hash_rank(df, ["id"], 3, 1, digits=digits).collect()}
        order = sorted(range(2000), key=lambda k: digest(k, 3, 1))
        assert got == {key: place for place, key in enumerate(order)}


def test_sample_has_the_exact_size(spark):
    df = spark.range(1003)
    for ratio in (0.0, 0.1, 0.37, 1.0):
        for digits in (1, 2):
            got = {r.id for r in ranks.hash_sample(df, ["id"], ratio, 9, 2, digits=digits).collect()}
            order = sorted(range(1003), key=lambda k: digest(k, 9, 2))
            assert got == set(order[: int(1003 * ratio)])


def test_epochs_redraw(spark):
    df = spark.range(500)
    one = {r.id for r in ranks.hash_sample(df, ["id"], 0.5, 1, 0).collect()}
    two = {r.id for r in ranks.hash_sample(df, ["id"], 0.5, 1, 1).collect()}
    assert one != two and len(one) == len(two) == 250


def test_progress_counts_missing_tiles(spark):
    from gridloom.operators.checkpoints import missing_tiles, tile_progress

    expected, written = spark.range(10).toDF("tile"), spark.range(7).toDF("tile").union(spark.range(3).toDF("tile"))
    assert tile_progress(expected, written, ["tile"]).collect()[0] == (10, 7, 3)
    assert {r.tile for r in missing_tiles(expected, written, ["tile"]).collect()} == {7, 8, 9}


def test_dimension_is_dense(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "v string")
    assert sorted(map(tuple, ranks.dimension(df, "v", "k").collect())) == [("a", 0), ("b", 1)]
    assert ranks.dimension(df.where(F.lit(False)), "v", "k").count() == 0


def test_lookup_join_with_heavy_keys(spark):
    rows = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700).alias("k"))
    table = spark.range(600).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = {r.id: r.v for r in ranks.lookup_join(rows, table, ["k"]).collect()}
    assert len(got) == 4000
    for r in rows.collect():
        assert got[r.id] == (r.k * 2 if r.k < 600 else None)


def test_lookup_join_is_dealt_for_the_join(spark):
    """Both sides of the join are exchanged for it, the condition for splitting a crowded key."""
    rows = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    table = rows.groupBy("k").agg(F.max("id").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = ranks.lookup_join(rows, table, ["k"])._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(deal_", plan)) == 2

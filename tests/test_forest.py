"""The forest that grows where its rows are, against MLlib's trees and by hand."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from gridloom.catalog import QUERIES
from gridloom.operators import forest, models


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(3000, 6)), 2)
    x[:, 3] = rng.integers(0, 5, len(x))
    x[:, 4][rng.random(len(x)) < 0.3] = -1
    y = (x[:, 0] + x[:, 1] * x[:, 3] + rng.normal(size=len(x)) > 0).astype(float) + (x[:, 5] > 1.2)
    return x, y


@pytest.fixture(scope="module")
def rows(spark, numbers):
    x, y = numbers
    data = [(k, v, float(c)) for k, (v, c) in enumerate(zip(x.tolist(), y))]
    return spark.createDataFrame(data, "id int, features array<double>, hit double").repartition(5).localCheckpoint()


@pytest.mark.parametrize("group,cells", [(10**9, 2**21), (500, 2**21), (40, 2**21), (500, 300)])
@pytest.mark.parametrize("depth", [3, 12])
def test_a_tree_of_all_rows_and_features_is_that_of_mllib(monkeypatch, numbers, rows, group, cells, depth):
    """However much of it grows in one task, and in however many slices."""
    monkeypatch.setattr(forest, "CELLS", cells)
    monkeypatch.setattr(forest, "GAINS", cells)
    x, _ = numbers
    data = rows.withColumn("vector", array_to_vector("features"))
    twin = RandomForestClassifier(
        labelCol="hit", featuresCol="vector", numTrees=1, maxDepth=depth, bootstrap=False, seed=42
    ).fit(data)
    told = twin.transform(data).select("id", "prediction", vector_to_array("probability").alias("p")).collect()
    model = forest.grow(rows, "hit", "features", len(x), 3, 1, depth, 42, bootstrap=False, group=group)
    borders, [(feature, border, left, shares)], _ = model.shipped.value
    flat = forest._binned(x, borders).ravel()
    mine = shares[-1 - left[forest._descend(feature, border, left, flat, np.arange(len(x)) * 6)]]
    assert np.allclose([r.p for r in sorted(told, key=lambda r: r.id)], mine, atol=1e-12)
    found = {r.id: r.prediction for r in model.transform(rows, "features").select("id", "prediction").collect()}
    assert found == {r.id: r.prediction for r in told}


def test_a_forest_of_many_leaves_does_not_grow_in_the_driver(monkeypatch, rows):
    def fit(self, data):
        raise AssertionError("the driver holds the nodes of all trees")

    monkeypatch.setattr(models.RandomForestClassifier, "fit", fit)
    model = models.fit_forest(rows, "hit", depth=12)
    out = models.apply_forest(model, rows)
    assert out.schema.fieldNames() == ["id", "features", "hit", "prediction"]
    right, n, ids = out.agg(F.count_if(F.expr("prediction = hit")), F.count("*"), F.count_distinct("id")).first()
    assert n == ids == 3000 and right > 2900
    with pytest.raises(ValueError, match="whole numbers"):
        models.fit_forest(rows.withColumn("hit", F.col("hit") + 0.5), "hit")
    with pytest.raises(ValueError, match="one length"):
        models.fit_forest(rows.withColumn("features", F.slice("features", 1, F.col("id") % 2 + 1)), "hit")


@pytest.mark.parametrize("group", [forest.GROUP, 1000])
def test_a_forest_does_as_well_as_that_of_mllib_on_rows_it_has_not_seen(rows, group):
    seen, rest = rows.where("id % 3 > 0").localCheckpoint(), rows.where("id % 3 = 0")
    vectors = seen.withColumn("vector", array_to_vector("features"))
    twin = RandomForestClassifier(labelCol="hit", featuresCol="vector", numTrees=30, maxDepth=10, seed=42).fit(vectors)
    model = forest.grow(seen, "hit", "features", 2000, 3, 30, 10, 42, group=group)
    right = [
        models.apply_forest(m, rest).where("prediction = hit").count() for m in (twin, model)
    ]
    assert abs(right[0] - right[1]) < 40 and right[1] > 700, right


def test_the_same_forest_grows_however_much_of_it_grows_in_one_task(rows):
    """Draws hang on the block, and features on the node."""
    model, other = (forest.grow(rows, "hit", "features", 3000, 3, 5, 9, 7, group=g) for g in (10**9, 100))
    a, b = ({r.id: r.prediction for r in m.transform(rows, "features").collect()} for m in (model, other))
    assert a == b


def test_features_are_drawn_evenly_and_alike_in_every_task():
    rules = forest.Rules(42, 2, 100, 16, 42, True, 7)
    nodes = np.arange(1, 20001)
    drawn = forest.drawn_features(rules, 3, nodes)
    assert (np.diff(drawn, axis=1) > 0).all()  # none comes twice
    assert (abs(np.bincount(drawn.ravel()) / 20000 - 7 / 42) < 0.015).all()
    assert (forest.drawn_features(rules, 3, nodes[5:6]) == drawn[5]).all()
    assert (forest.drawn_features(rules, 4, nodes) != drawn).any(axis=1).mean() > 0.9


def test_borders():
    assert forest.borders_of(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    assert len(forest.borders_of(np.ones(5))) == 0
    borders = forest.borders_of(np.arange(320.0))
    assert borders.tolist() == [k * 10 - 0.5 for k in range(1, 32)]


def test_pixels_go_down_the_trees_once(spark, tmp_path):
    """Two scores read the predictions: they are stored, and neither model nor features are in the plan."""
    n = 40 * 16
    spark.range(12 * n).selectExpr(
        "id AS l_orderkey", f"id % {n} AS l_partkey", "CAST(id % 7 AS INT) AS l_linenumber",
        "CAST(1 + id % 7 AS DOUBLE) AS l_quantity", "CAST(id * 31 % 997 AS DOUBLE) AS l_extendedprice",
        "(id % 11) / 100.0D AS l_discount", "(id % 9) / 100.0D AS l_tax", "'A' AS l_returnflag",
        "make_timestamp_ntz(CAST(1995 + id % 5 AS INT), 6, 1, 0, 0, 0) AS l_shipdate",
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(0, 4800, 5).selectExpr(
        "id AS o_orderkey", "id * 7 % 1500 AS o_custkey", "'1-URGENT' AS o_orderpriority",
        "make_timestamp_ntz(1996, 6, 1, 0, 0, 0) AS o_orderdate",
    ).write.parquet(f"{tmp_path}/orders.parquet")
    out = QUERIES["m1_pixel_forest"](spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "UDF" not in plan and "MapInArrow" not in plan and "features" not in plan
    assert sum(r.tp + r.fp + r.fn + r.tn for r in out.where("direction = 'forward'").collect()) == n

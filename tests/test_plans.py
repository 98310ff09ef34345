"""Physical plans of every registered query, with automatic broadcasts switched off."""

import re

import pytest

from gridloom.catalog import QUERIES
from gridloom.catalog.base import TABLES

FOLDER = "/root/testdata/sf0.001"
THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def no_broadcast(spark):
    for key in THRESHOLDS:
        spark.conf.set(key, "-1")
    yield spark
    for key in THRESHOLDS:
        spark.conf.unset(key)


def nodes(plan: str) -> list[str]:
    return [re.sub(r"^[\s:+\-*()\d]*", "", line) for line in plan.splitlines()]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"m1_pixel_forest", "m1_forest_checks"}))
def test_plan_scales(no_broadcast, name):
    df = QUERIES[name](no_broadcast, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    lines = nodes(plan)
    for k, line in enumerate(lines):
        # no join without an equality key
        assert not line.startswith(("BroadcastNestedLoopJoin", "CartesianProduct")), line
        if line.startswith("Exchange SinglePartition"):
            # rows meet in one task only after an aggregation has shrunk them
            below = lines[k + 1]
            assert "Aggregate" in below.split("(")[0], below
            assert "functions=[]" not in below, below  # a bare distinct may have shrunk nothing


# fitting a model and writing a table are jobs by their nature
@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n[0] not in "ms"))
def test_building_runs_no_job(spark, name):
    """Only the schema of each table is read while a query is put together."""
    context = spark.sparkContext
    context.setJobGroup(f"build {name}", name)
    QUERIES[name](spark, FOLDER)
    started = context.statusTracker().getJobIdsForGroup(f"build {name}")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(started) <= len(TABLES), len(started)


def test_filters_and_columns_reach_the_scan(spark):
    plan = QUERIES["p1_date_filter"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "LessThan(l_shipdate" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} <= {"l_shipdate", "l_returnflag"}


@pytest.mark.parametrize("name", ["a5_median_composite", "a7_monthly_medoid"])
def test_medians_read_and_shuffle_the_rows_once(spark, name):
    df = QUERIES[name](spark, FOLDER)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert final.count("Exchange hashpartitioning") == 1 and final.count("FileScan") == 1, final
    assert "Expand" not in final and "Join" not in final


def test_similarity_shuffles_the_image_once(spark):
    plan = QUERIES["a20_ssim_uniform"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1
    assert plan.count("Exchange hashpartitioning") == 2  # tiles, then one partial mean per image

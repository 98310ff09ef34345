"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from gridloom.catalog import ORACLES, QUERIES
from tools.check import compare

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(FOLDER)):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, duck, name):
    message, _ = compare(QUERIES[name](spark, FOLDER), duck.sql(ORACLES[name]))
    assert not message, message


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"m1_pixel_forest", "m2_projection"}

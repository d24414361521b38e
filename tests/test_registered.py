"""Every registered query beside its checking SQL, on the smallest tables."""

import pytest
from check import compare, database

from heliospark.catalog import registered

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered()


@pytest.fixture(scope="module")
def con():
    return database(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert compare(got, con.execute(ORACLES[name]).df()) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    assert len(set(got.columns)) == len(got.columns)


def test_only_registered_sql():
    assert set(ORACLES) <= set(QUERIES)


def test_boundary_map_has_both_spheres(spark):
    rows = QUERIES["boundary_map"](spark, SF).groupBy("snapshot_id").pivot("sphere", [0, 1]).count().collect()
    assert rows and all(r["0"] == r["1"] == 8 * 12 for r in rows)

"""Every catalogue query against its SQL twin on DuckDB."""

import pytest
from compare import SMALL, compare, duck

import __spark_entry__ as entry

from weblode.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES.get(name), SMALL) in ("", "empty on both sides")


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["job_id", "domain", "outcome", "links"] and rows.count() > 0


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry_offers_the_catalogue():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())

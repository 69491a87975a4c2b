"""Every registered query that has an SQL twin returns the twin's rows."""

import os

import pytest
from oracle import compare, connect

from plumbline.plans import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    equal, message = compare(QUERIES[name](spark, SF), con, ORACLES[name])
    assert equal, message


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_twin(spark, name):
    assert QUERIES[name](spark, SF).count() > 0

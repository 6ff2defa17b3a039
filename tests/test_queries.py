"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
import queries as registered
from tests.oracle import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
ORACLE = registered.all_oracles()


def test_every_query_has_an_oracle():
    assert set(registered.all_queries()) == set(registered.all_oracles())


def test_entry_has_rows(spark):
    counts = {r["status"]: r["n"] for r in driver.entry(spark).collect()}
    assert counts["only_source"] == 30 and counts["only_target"] == 13 and counts["changed"] == 102


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, name):
    assert compare(spark, SF, driver.queries()[name], ORACLE[name], connect(SF)) is None

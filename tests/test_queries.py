import os

import pytest

import __spark_entry__ as entry
from tests.compare import connect, differences
from workload import all_oracles, all_queries

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(all_oracles()))
def test_query_matches_its_sql(spark, con, name):
    run, sql = all_queries()[name], all_oracles()[name]
    assert differences(spark, con, run, sql, FOLDER) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query with an oracle equals DuckDB on the sf0.001 tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle_harness import compare, duck

SF = os.environ.get("LEDGERLAKE_TEST_SF", "/root/testdata/sf0.001")
ORACLES = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, SF, name, queries(), ORACLES)
    assert r["status"] == "ok", r


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["num_conta", "total"]
    assert df.count() >= 0

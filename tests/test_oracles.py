"""Every registered query against its DuckDB oracle on the smallest scale."""

import pytest

import __spark_entry__ as entry
from shapelens.plans import registry
from tools.oracle_check import check, duck_connection

from conftest import SF_SMALL

# The library's own queries; those of the training-data operators have tests of their own.
QUERIES = dict(registry.QUERIES)
ORACLES = dict(registry.ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = check(spark, con, name, SF_SMALL, QUERIES, ORACLES)
    assert res["ok"] is not False, res


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() >= 0
    assert df.columns == ["pattern", "count", "types", "sample_keys"]

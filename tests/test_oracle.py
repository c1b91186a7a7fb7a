"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle_check import compare, duck

SF = os.environ.get("TUNEFRAME_TEST_SF", "/root/testdata/sf0.001")
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, QUERIES[name], ORACLES.get(name), SF, con)
    if name in ORACLES:
        assert r["cols_ok"], r
        assert r["hash_ok"], r
    else:
        assert r["rows"] >= 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert {"input_ids", "seq_lengths", "position_ids", "labels"} <= set(df.columns)

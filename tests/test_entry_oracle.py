"""Driver contract and every registered query against its DuckDB oracle (sf0.01)."""
import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck

SF = "/root/testdata/sf0.01"


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "line_count" in df.columns


def test_contract_names():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 40


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    ok, n, _, detail = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF)
    assert ok, detail

"""Every registered report against its DuckDB oracle at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

from conftest import SF_ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_ORACLE)


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_matches_oracle(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], E.oracle_sql()[name], SF_ORACLE)
    assert r["cols_match"], r
    assert r["rows"][0] == r["rows"][1], r
    assert r["exact"], r
    assert r["type_diff"] == {}, r
    # an integer column with a NULL that its contract asks for comes as float64 and as a nullable integer
    assert all(d == ("float64", "Int64") for d in r["pandas_diff"].values()), r

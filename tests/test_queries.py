"""Every registered query against its SQL, at the smallest scale."""

import pytest

import __spark_entry__ as contract
from tests.check import compare, duck

QUERIES = {n: q for n, q in contract.queries().items() if n.startswith("o_")}
SQL = {n: s for n, s in contract.oracle_sql().items() if n.startswith("o_")}


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, name, QUERIES[name], SQL[name], sf_dir) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["rank", "id", "price_eur", "score"]
    assert df.limit(3).count() == 3

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from faultline import catalog

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(request):
    return duck("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_its_sql(spark, con, sf, name):
    _, rows, _, verdict = compare(spark, con, name, entry.queries()[name], SQL.get(name), sf)
    assert verdict == "ok", verdict


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_sql_only_for_registered_queries():
    assert set(SQL) <= set(entry.queries())

"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as driver
from docengine.plans.queries import QUERIES
import oracle

FOLDER = "/root/testdata/sf0.001"
SQL = driver.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


# Fitted centres have no SQL; test_ivf holds this one against the exact search.
WITHOUT_SQL = {"ivf_recall"}


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in WITHOUT_SQL])
def test_query_equals_sql(spark, connection, name):
    df = driver.queries()[name](spark, FOLDER)
    assert oracle.compare(df, connection, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL <= set(SQL)


def test_entry(spark):
    assert driver.entry(spark).count() == 4

"""Every query with an SQL twin gives the same rows and column names."""

import pytest

import __spark_entry__ as entry
from oracle import rows_of, views

CORE = [n for n in entry.oracle_sql()]


@pytest.mark.parametrize("name", CORE)
def test_same_rows(spark, folder, name):
    got = entry.queries()[name](spark, folder).toPandas()
    want = views(folder).execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_has_rows(spark, folder):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", [n for n in entry.queries() if n not in entry.oracle_sql()])
def test_rows_twice_the_same(spark, folder, name):
    """A query without an SQL twin has rows, and the same ones when it runs again."""
    first, again = (rows_of(entry.queries()[name](spark, folder).toPandas().map(str)) for _ in range(2))
    assert first == again and len(first) > 0

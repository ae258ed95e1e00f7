"""Every query against DuckDB on the smallest tables; those without SQL run and give rows."""

import pytest
from conftest import SF

from turnlake import queries as Q


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_matches_sql(spark, duck, same, name):
    same(Q.QUERIES[name](spark, SF), Q.SQL[name], duck)


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.SQL)))
def test_gives_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

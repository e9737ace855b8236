"""Every query with SQL against DuckDB."""

from __future__ import annotations

import pytest

from stowage import queries as own

from .conftest import DATA, same


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    same(own.QUERIES[name](spark, DATA).toArrow(), duck.sql(own.ORACLE_SQL[name]).to_arrow_table())


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    found = entry.queries()
    assert set(own.QUERIES) <= set(found)
    assert set(entry.oracle_sql()) <= set(found)
    assert entry.entry(spark).count() == 200

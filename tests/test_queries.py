"""Every query with SQL against DuckDB, on the smallest tables."""

import pytest

from kindred.plans import exports, linking, lookups, names, objectives, registry, research, streams, summaries, tree  # noqa: F401

from .harness import connect, differences

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, con, name):
    assert differences(spark, con, name, SF, registry.QUERIES, registry.SQL) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_rows(spark, name):
    assert not registry.QUERIES[name](spark, "/root/testdata/sf0.001").isEmpty()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["fk", "mk", "first_id"]

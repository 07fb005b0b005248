"""Every query of the engine against its SQL, and what the entry module promises."""

import pytest

from veilmap.queries import HEADLINE, QUERIES, SQL

from .conftest import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, name):
    compare(QUERIES[name](spark, sf), SQL[name], sf)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["tile", "visible", "matched", "highlighted"] and df.count() > 0
    assert set(HEADLINE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["tree_cut", "hull"])
def test_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0

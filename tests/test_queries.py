"""Every query that has SQL gives the same rows; the others run and give rows."""

import os

import pytest
from oracle import check

from paperlane.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()
QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    check(QUERIES[name], SQL[name], spark, FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    d = registry.flagship(spark, FOLDER)
    assert d.columns == ["doc_id", "slug", "is_eligible", "n_failed", "n_triggered"]
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())

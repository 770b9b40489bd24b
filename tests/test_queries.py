"""Every registered query against its check on the smallest tables."""

import pytest
from compare import connect, difference

from clauselight.catalog import load

SF_DIR = "/root/testdata/sf0.001"
QUERIES = load()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_a_check():
    assert [q.name for q in QUERIES.values() if q.check is None] == []


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_its_check(spark, con, name):
    query = QUERIES[name]
    assert difference(query.run(spark, SF_DIR), con, query.check) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

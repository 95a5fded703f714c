"""Every registered query against its SQL on the smallest tables."""

import pytest
from compare import connect, difference

from veinstone.registry import all_queries

SF = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_names_are_unique():
    assert len({q.name for q in QUERIES}) == len(QUERIES)


@pytest.mark.parametrize("query", [q for q in QUERIES if q.sql], ids=lambda q: q.name)
def test_equals_sql(spark, con, query):
    diff, _ = difference(spark, con, query, SF)
    assert diff is None


@pytest.mark.parametrize("query", [q for q in QUERIES if not q.sql], ids=lambda q: q.name)
def test_has_rows(spark, query):
    assert query.run(spark, SF).count() > 0

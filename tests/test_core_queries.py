import pytest

from glyphloom import core_queries


@pytest.mark.parametrize("name", sorted(core_queries.SQL))
def test_query_equals_sql(name, same):
    cols, theirs, a, b = same(name, core_queries.QUERIES, core_queries.SQL)
    assert cols == theirs
    assert a == b


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.SQL)))
def test_query_without_sql_runs(name, spark, sf):
    df = core_queries.QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0

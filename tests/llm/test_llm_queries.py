import pytest

from glyphloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(name, same):
    cols, theirs, a, b = same(name, queries.QUERIES, queries.SQL)
    assert cols == theirs
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(name, spark, sf):
    df = queries.QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0

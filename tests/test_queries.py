import pytest

from bitloom import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(queries.QUERIES[name](spark, sf_dir), queries.SQL[name])


def test_entry_registers_queries(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1000

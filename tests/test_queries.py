import oracle
import pytest

from sediment import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert oracle.spark_rows(queries.queries()[name](spark, sf_dir)) == oracle.sql_rows(sf_dir, SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).head(1)


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).head(1)
    assert set(entry.oracle_sql()) <= set(entry.queries())

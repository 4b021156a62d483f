import pytest

from tkanyna.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_of_sql(name, same_rows):
    same_rows(queries.queries()[name], SQL[name])

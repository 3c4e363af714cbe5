"""Every registered llm query: against its SQL, or that it gives rows."""

import pytest

from tesserae.llm import queries as llm
from tests.test_queries import SF, duck, pytestmark, rows  # noqa: F401


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, duck, name):  # noqa: F811
    own, other = llm.queries()[name](spark, SF), duck.execute(llm.oracle_sql()[name])
    columns = [d[0] for d in other.description]
    assert sorted(own.columns) == sorted(columns)
    assert rows(own.columns, own.collect()) == rows(columns, other.fetchall())


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_queries_without_sql_run(spark, name):
    assert llm.queries()[name](spark, SF).count() > 0

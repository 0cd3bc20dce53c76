"""Every training-data query beside its SQL, or else that it runs."""

import pytest
from oracle import differ

from loreforge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, data, name):
    assert differ(queries.QUERIES[name](spark, data), queries.SQL[name], data) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0

"""Every registered query of the core beside its SQL."""

import pytest
from oracle import differ

from loreforge.plans import general, search, upkeep, whole

QUERIES = {n: (f, m.SQL.get(n)) for m in (general, search, upkeep, whole) for n, f in m.QUERIES.items()}
#: Random by nature or rendered by Python: checked in their own tests, here only that they run.
PLAIN = sorted(n for n, (_, sql) in QUERIES.items() if sql is None)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(PLAIN)))
def test_same_as_sql(spark, data, name):
    f, sql = QUERIES[name]
    assert differ(f(spark, data), sql, data) is None


@pytest.mark.parametrize("name", PLAIN)
def test_runs(spark, data, name):
    assert QUERIES[name][0](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

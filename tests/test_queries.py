"""Every registered query of the engine runs, and equals its SQL."""

import pytest

from graphloom.plans import queries as base
from oracle import compare

#: Queries whose rounds take long run elsewhere in the suite, on small graphs.
LONG = {"leiden", "hierarchical_leiden", "louvain"}


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_query_equals_its_sql(spark, data, name):
    compare(base.QUERIES[name](spark, data), base.SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.SQL) - LONG))
def test_query_without_sql_runs(spark, data, name):
    assert base.QUERIES[name](spark, data).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_imports_without_the_training_data_operators(monkeypatch):
    import __spark_entry__ as e

    monkeypatch.setattr(e, "_llm", lambda: None)
    assert set(e.queries()) == set(base.QUERIES)

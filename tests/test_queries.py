import pytest

import __spark_entry__ as entry
from tallyfold.plans.oracle import SQL
from tallyfold.plans.queries import QUERIES

from .oracle import rows, tables


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, name):
    assert rows(QUERIES[name](spark, sf)) == rows(tables(sf).execute(SQL[name]))


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 28


def test_registry_is_whole():
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["model_tweedie_scores", "model_tree_scores", "model_categories"])
def test_models_score(spark, sf, name):
    row = QUERIES[name](spark, sf).first()
    assert row.rows > 0 and row.wmae > 0

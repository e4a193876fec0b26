"""Every registered query with an SQL twin gives the same rows as the twin."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
from cinegrade.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, con, name):
    assert compare(QUERIES[name](spark, sf_dir), con, ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "term", "n", "df", "tfidf"]
    assert not df.isEmpty()


LIGHT = sorted(n for n in QUERIES if n in ORACLES or n in ("closest_title_ratio", "hashing_tf", "rating_fit"))


@pytest.mark.parametrize("name", LIGHT)
def test_no_join_without_a_key(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan

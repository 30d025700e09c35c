"""Every query of the core against its SQL; those without SQL must run and keep their schema."""

import pytest

from rankmill.plans import catalog, catalog_more, core_problems

ALL = catalog.QUERIES | catalog_more.QUERIES | core_problems.QUERIES
SQL = catalog.SQL | catalog_more.SQL | core_problems.SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, same):
    same(ALL[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_runs(name, spark, folder):
    df = ALL[name](spark, folder)
    assert len(df.collect()) > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "doc_id", "score", "rank"]
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans(spark, folder):
    """Top-k is limited before its shuffle, joins are on keys, scans are pruned."""
    plan = catalog.QUERIES["bm25_topk"](spark, folder)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan
    plan = core_problems.QUERIES["p6_found"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "body" not in plan

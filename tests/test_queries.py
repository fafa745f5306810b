"""Every registered query: against its SQL, for its plan, and the entry point."""

import pytest

import __spark_entry__ as entry
from compare import database, differences
from marketprose.queries.registry import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
FITS = {"nmf_fit", "lda_fit", "post_topics", "article_topics"}


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, con, name):
    rows, problems = differences(spark, con, name, SF_DIR)
    assert problems == []
    assert rows > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITS))
def test_plan_stays_in_spark_and_joins_on_keys(spark, name):
    plan = entry.queries()[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


@pytest.mark.parametrize("name", sorted(FITS))
def test_fits_run(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20 and rows[0].asDict().keys() == {"word", "freq"}
    assert [r["freq"] for r in rows] == sorted((r["freq"] for r in rows), reverse=True)

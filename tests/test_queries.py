from __future__ import annotations

import pytest

from pyspark.sql.classic.dataframe import DataFrame

from tallyfold import jobs
from tests.compare import assert_same, connection


@pytest.fixture(scope="module")
def con(sf_dir):
    return connection(sf_dir)


@pytest.mark.parametrize("name", sorted(jobs.oracles()))
def test_same_as_sql(spark, sf_dir, con, name):
    if name in ("A6_betas", "A6_t_values", "IO8_wide_betas"):  # ten assets leave buckets empty, and regressors that are all zero
        sf_dir = sf_dir.replace("sf0.001", "sf0.01")
        con = connection(sf_dir)
    assert_same(jobs.queries()[name](spark, sf_dir), con, jobs.oracles()[name])


@pytest.mark.parametrize("name", sorted(set(jobs.queries()) - set(jobs.oracles())))
def test_runs(spark, sf_dir, name):
    assert jobs.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name,most", [("W1_ma", 1), ("M7_all_metrics", 1), ("X11_positions", 1), ("A3_five_factors", 2), ("A6_attribution", 3)])
def test_lineitem_is_read_once(spark, sf_dir, monkeypatch, name, most):
    """Scans of the largest table in a query's plan and in those of the checkpoints that it makes."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet")
    old = DataFrame.checkpoint
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda self, *a: plans.append(plan(self)) or old(self, *a))
    plans.append(plan(jobs.queries()[name](spark, sf_dir)))
    assert sum(plans) <= most


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["date", "rm", "smb", "hml", "rmw", "cma"] and df.count() > 0

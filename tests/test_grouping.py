"""Grouping by rounds equals grouping of one matrix, whatever the most series of a task."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.operators import cluster, grouping


def _matrices():
    rng = np.random.default_rng(3)
    for u, n in (("x", 10), (None, 7), ("z", 1), ("", 6)):
        common = rng.normal(size=(3, 6))
        m = np.corrcoef(rng.normal(size=(n, 6)) + 1.5 * common[rng.integers(0, 3, n)]).reshape(n, n)
        yield u, np.where(np.eye(n), 1.0, (m + m.T) / 2)


def _pairs(spark):
    flat = [(u, f"s{i:02d}", f"s{j:02d}", float(m[i, j])) for u, m in _matrices() for i in range(len(m)) for j in range(len(m))]
    return spark.createDataFrame(flat, "u string, a string, b string, corr double").repartition(3)


@pytest.mark.parametrize(("most", "thresholds", "further"), [(2, [0.1], False), (4, [-0.2, 0.5], False), (6, None, False), (6, [-0.5], True)])
def test_groups_of_large_universes(spark, most, thresholds, further):
    got = {(r["u"], r["series_id"]): (r["order_no"], r["path"]) for r in cluster.grouped(_pairs(spark), thresholds, "u", most, further).collect()}
    want = {(u, f"s{i:02d}"): (k, list(p)) for u, m in _matrices() for k, (i, p) in enumerate(cluster.tree_order(m, thresholds, further=further))}
    assert got == want


def test_thresholds_of_large_universes(spark):
    got = {r["u"]: r["threshold"] for r in cluster.chosen_threshold(_pairs(spark), "u", 7).collect()}
    assert got == {u: pytest.approx(cluster.best_threshold(m), abs=1e-12) for u, m in _matrices()}


def test_ties_go_to_the_smaller_series(spark):
    """All correlations the same: series join in their own order, and a task never holds more than two."""
    flat = [(i, j, 1.0 if i == j else 0.1) for i in range(6) for j in range(6)]
    rows = cluster.grouped(spark.createDataFrame(flat, "a int, b int, corr double"), [0.0], most=2).orderBy("order_no").collect()
    assert [r["series_id"] for r in rows] == list(range(6)) and {tuple(r["path"]) for r in rows} == {(0,)}
    alone = cluster.grouped(spark.createDataFrame(flat, "a int, b int, corr double"), [0.1], most=2).orderBy("order_no").collect()
    assert [(r["series_id"], r["path"]) for r in alone] == [(i, [i]) for i in range(6)]


def test_a_round_reads_the_slabs_it_needs(spark, monkeypatch):
    monkeypatch.setattr(grouping, "SLAB_PAIRS", 10)
    matrix = grouping.Matrix(_pairs(spark).withColumn("u", F.coalesce("u", F.lit("null"))))
    one = matrix.of(spark.createDataFrame([("x", "s03")], "u string, s string"))
    assert one.count() == 10 and matrix.slabs > 10
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [slab" in plan.replace("isnotnull(", "")

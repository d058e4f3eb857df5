"""Long groups in parts: the same rows as whole groups give, and no part with a whole group."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyfold.operators import ordered, performance, selection, windows, xsec


@pytest.fixture(scope="module")
def crowd(spark):
    """One date with most rows, others with few, a null date; values with ties, missing and infinite ones."""
    rnd = random.Random(3)
    value = lambda k: rnd.choice([None, 1.0, 1.0, 2.5, float("inf"), float("-inf"), round(rnd.gauss(0, 1), 1), rnd.lognormvariate(0, 20)])
    rows = [(k, None if k % 50 == 7 else 0 if k % 9 else k % 4, value(k), value(k), k % 3, rnd.random() < 0.7) for k in range(900)]
    return spark.createDataFrame(rows, "asset int, date int, x double, y double, region int, ok boolean").repartition(5).cache()


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("rows", [40])
def test_ranks_over_many_tasks(crowd, rows):
    x = F.col("x")
    same(xsec.with_rank(crowd, x, rows=rows), xsec.with_rank(crowd, x))
    same(xsec.with_pct(crowd, x, rows=rows), xsec.with_pct(crowd, x))
    same(xsec.with_pct(crowd, F.when(F.col("ok"), x), older=True, rows=rows), xsec.with_pct(crowd, F.when(F.col("ok"), x), older=True))
    same(xsec.with_top_n(crowd, x, F.col("ok"), 30, rows=rows), xsec.with_top_n(crowd, x, F.col("ok"), 30))
    same(xsec.between_pct(crowd, x, F.col("ok"), 0.2, 0.6, rows=rows), xsec.between_pct(crowd, x, F.col("ok"), 0.2, 0.6))
    same(xsec.select_in_regions(crowd, "x", "region", 0.2, 0.6, rows=rows), xsec.select_in_regions(crowd, "x", "region", 0.2, 0.6))
    regions = [F.col("ok"), F.col("y") > 1, F.col("region") == 1]
    dated = crowd.filter("date is not null")
    same(xsec.rank_select(dated, x, regions, 0.2, 0.6, F.col("asset") > 50, rows=rows), xsec.rank_select(dated, x, regions, 0.2, 0.6, F.col("asset") > 50))


def test_ranks_by_hand(crowd):
    got = {r["asset"]: r["place"] for r in xsec.with_rank(crowd, F.col("x"), rows=40).collect()}
    rows = crowd.collect()
    for day in {r["date"] for r in rows}:
        mine = sorted((r for r in rows if r["date"] == day), key=lambda r: (r["x"] is None, r["x"] or 0.0, r["asset"]))
        assert [got[r["asset"]] for r in mine] == list(range(len(mine)))


def test_no_part_has_a_whole_date(crowd):
    parts = ordered.by_splitters(crowd, ("date",), [F.col("x").isNull(), F.col("x"), F.col("asset")], 50)
    sizes = parts.df.groupBy("date", "_part").count().collect()
    assert parts.split and max(r["count"] for r in sizes) < 150 and len({r["_part"] for r in sizes if r["date"] == 0}) > 10
    whole = ordered.by_splitters(crowd, ("date",), [F.col("asset")], 10_000)
    assert not whole.split and whole.df.filter("_part != 0").isEmpty()


def test_parts_of_equal_values(spark):
    """A third of a date on one value: the asset tells them apart, so that they are split as well."""
    d = spark.range(3000).select(F.col("id").alias("asset"), F.lit(0).alias("date"), F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") / 100).alias("x"))
    parts = ordered.by_splitters(d, ("date",), [F.col("x").isNull(), F.col("x"), F.col("asset")], 200)
    assert parts.df.groupBy("_part").count().agg(F.max("count")).first()[0] < 700


@pytest.mark.parametrize("rows", [1, 400])
def test_percentiles_by_histograms(crowd, rows):
    wanted = {"x": [0.0, 0.3, 0.5, 0.7, 1.0], "y": [0.5, 0.123]}
    same(selection.percentiles(crowd, wanted, rows=rows), selection.percentiles(crowd, wanted))
    none = crowd.withColumn("y", F.lit(None).cast("double"))
    same(selection.percentiles(none, {"y": [0.5]}, rows=rows), selection.percentiles(none, {"y": [0.5]}))


def test_percentiles_to_the_last_bit(spark):
    rnd = random.Random(8)
    hard = [5e-324, 1e-323, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0000000000000002, 0.1, 0.2, 0.3, 1e16, 1e16 + 2]
    rows = [(g, rnd.choice(hard) if g == 0 else rnd.random() * 10.0 ** rnd.randrange(-300, 300)) for g in (0, 1) for _ in range(400)] + [(2, float("nan"))] * 3 + [(2, 4.0)]
    d = spark.createDataFrame(rows, "date int, x double")
    wanted = {"x": [k / 20 for k in range(21)]}
    same(selection.percentiles(d, wanted, rows=1), d.groupBy("date").agg(F.percentile("x", F.array(*[F.lit(p) for p in wanted["x"]])).alias("x")))


@pytest.fixture(scope="module")
def panel(spark):
    rnd = random.Random(4)
    rows = [(a, i, rnd.choice([None, rnd.gauss(0, 9), 2.0]), rnd.random() < 0.2) for a in (None, 1, 2) for i in range(120 if a == 1 else 13)]
    return spark.createDataFrame(rows, "asset int, i int, x double, b boolean").repartition(4).cache()


@pytest.mark.parametrize("block", [1, 7])
def test_blocks_with_halo(panel, block):
    x, b, i = F.col("x"), F.col("b"), F.col("i")
    make = lambda v: {
        "ma": windows.ma(x, 5, v, 2), "low": windows.min_roll(x, 9, v), "high": windows.max_roll(x, 9, v, 4), "all": windows.all_roll(b, 2, v), "since": windows.rows_since_max(x, i, 9, v), "n": windows.count_true(b, 9, v),
        "back": windows.ref(x, 3, v, -1.0), "ahead": windows.ref(x, -2, v, -1.0), "near": windows.mark_neighbors(b, 2, v), "std": windows.std_roll(x, 4, v, 1.0, 2), "ret": windows.reldiff(x, v), "cross": windows.cross(x, F.lit(0.0), v),
    }
    whole = panel.select("*", *[c.alias(n) for n, c in make(Window.partitionBy("asset").orderBy("i")).items()])
    same(ordered.rolling(panel, make, 8, 2, rows=block), whole)


@pytest.mark.parametrize("block", [7])
def test_states_from_block_to_block(panel, block):
    x, b = F.col("x"), F.col("b")
    for f in (
        lambda k: windows.ffill(panel, {"f": x, "g": F.when(b, x)}, block=k),
        lambda k: windows.pause(panel, x, b, block=k),
        lambda k: windows.reduce_freq(panel, x, 4, 2, block=k),
        lambda k: windows.reduce_freq(panel, x, 4, trade=b, block=k),
        lambda k: windows.reduce_freq_older(panel, x, 4, block=k),
        lambda k: windows.reduce_freq_staggered(panel, F.round(x), 6, 3, block=k),
        lambda k: windows.bars_since(panel, b, block=k),
        lambda k: windows.bars_held(panel, F.when(F.col("i") > 4, x), block=k),
        lambda k: windows.with_count_since(panel, b, x > 8, block=k),
        lambda k: windows.with_age(panel, b, block=k),
        lambda k: windows.with_dynamic_sum(panel.withColumn("n", F.pmod("i", F.lit(9))), F.round(x), "n", block=k),
    ):
        same(f(block), f(1000))
    parts = ordered.by_number(panel, rows=block)
    states = {"n": ordered.number(b), "t": ordered.total(F.round(x)), "p": ordered.product(F.when(b, 2.0).otherwise(1.0)), "lo": ordered.least(x), "hi": ordered.largest(x), "v": ordered.last_value(x)}
    for before in (False, True):
        same(ordered.running(parts, states, before).drop("_part"), ordered.running(ordered.by_number(panel, rows=1000), states, before).drop("_part"))


def test_performance_over_many_tasks(spark):
    rnd = random.Random(6)
    rows, start = [], datetime.date(2020, 1, 1)
    for s in ("a", "b"):
        v = 1.0
        for i in range(150 if s == "a" else 9):
            v *= rnd.choice([0.5, 1.0, 1.25, 2.0])
            rows.append((s, start + datetime.timedelta(i), None if i in (0, 44) else v, rnd.choice([0.5, -0.5, 0.25, None])))
    d = spark.createDataFrame(rows, "series_id string, date date, nav double, ret double").repartition(3).cache()
    same(performance.drawdown_rows(d, rows=10), performance.drawdown_rows(d))
    rounded = lambda m: m.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in m.dtypes])
    same(rounded(performance.metrics(d, rows=10)), rounded(performance.metrics(d)))
    same(rounded(performance.metrics(d, "ret", is_return=True, rows=10)), rounded(performance.metrics(d, "ret", is_return=True)))

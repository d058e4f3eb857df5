"""Hand cases; expected values follow from the definitions."""

from __future__ import annotations

import datetime as d

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.functions import cells, dates, text
from tallyfold.operators import align, cluster, factors, graph, linalg, panel, performance, xsec
from tallyfold.operators import windows as w


def rows(spark, **columns):
    names = list(columns)
    n = len(next(iter(columns.values())))
    kinds = {bool: "boolean", int: "long", float: "double", str: "string", d.date: "date"}
    kind = lambda v: next((kinds[type(x)] for x in v if x is not None), "double")
    schema = ", ".join(f"{k} {kind(v)}" for k, v in columns.items())
    return spark.createDataFrame([tuple(columns[k][j] for k in names) for j in range(n)], schema)


def one_asset(spark, **columns):
    n = len(next(iter(columns.values())))
    return rows(spark, asset=[1] * n, date=list(range(n)), i=list(range(n)), **columns)


def values(df, name="out", order="i"):
    return [r[name] for r in df.orderBy(order).collect()]


X, I = "x", "i"  # noqa: E741


def apply(spark, f, **columns):
    return values(one_asset(spark, **columns).withColumn("out", f(w.by_asset())))


def close(a, b):
    return [None if x is None else round(x, 9) for x in a] == [None if x is None else round(x, 9) for x in b]


def test_returns(spark):
    x = [100.0, 110.0, None, 121.0]
    assert close(apply(spark, lambda ws: w.reldiff(F.col(X), ws), x=x), [0, 0.1, 0, 0])
    assert close(apply(spark, lambda ws: w.nav2ret(F.col(X), F.col(I), ws), x=x), [0, 0.1, None, None])
    assert close(apply(spark, lambda ws: w.diff(F.col(X), ws), x=[1.0, 3.0, None, 6.0]), [1, 2, 0, 0])
    assert apply(spark, lambda ws: w.reldiff(F.col(X), ws), x=[0.0, 2.0, 0.0, 0.0]) == [0, float("inf"), -1, 0]


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_holding(spark, block):
    out = lambda f, **columns: values(f(one_asset(spark, **columns)), "held")
    assert out(lambda d_: w.pause(d_, F.col(X), F.col("p"), block=block), x=[1.0, 0.0, 1.0, 1.0], p=[True, False, True, False]) == [0, 0, 0, 1]
    seven = [float(k) for k in range(1, 8)]
    assert out(lambda d_: w.reduce_freq(d_, F.col(X), 3, block=block), x=seven) == [1, 1, 1, 4, 4, 4, 7]
    assert out(lambda d_: w.reduce_freq_older(d_, F.col(X), 3, block=block), x=seven) == [1, 1, 1, 1, 5, 5, 5]
    assert out(lambda d_: w.reduce_freq(d_, F.col(X), 2, block=block), x=[1.0, 2.0, None, 4.0]) == [1, 1, None, None]


@pytest.mark.parametrize("block", [1, 2, 1000])
def test_states(spark, block):
    b = [False, True, False, False, True, False]
    assert values(w.bars_since(one_asset(spark, b=b), F.col("b"), "out", block=block)) == [0, 1, 0, 1, 2, 0]
    assert values(w.bars_held(one_asset(spark, x=[None, None, 5.0, None, 7.0]), F.col(X), "out", block=block)) == [0, 0, 1, 2, 3]
    aged = w.with_age(one_asset(spark, m=[False, False, True, True, True, False, False]), F.col("m"), block=block)
    assert values(aged, "age") == [0, -1, 0, 1, 2, 0, -1]
    counted = w.with_count_since(one_asset(spark, y=b), F.lit(True), F.col("y"), block=block)
    assert values(counted, "count_since") == [1, 1, 3, 1, 2, 6]
    summed = w.with_dynamic_sum(one_asset(spark, x=[1.0, 2.0, 3.0, 4.0], n=[1, 3, 2, 0]), F.col(X), "n", block=block)
    assert values(summed, "sum") == [1, None, 5, 10]
    assert values(w.with_dynamic_sum(one_asset(spark, x=[1.0, 2.0], n=[-1, 0]), F.col(X), "n", block=block), "sum") == [None, 3]
    moved = w.ref_dynamic(one_asset(spark, x=[1.0, None, 3.0], n=[1, 0, 1]), X, "n", fill=-1.0)
    assert values(moved, "ref") == [-1, None, None]


def test_rolling(spark):
    assert apply(spark, lambda ws: w.rows_since_max(F.col(X), F.col(I), 3, ws), x=[1.0, 3.0, 2.0, 2.0, 5.0]) == [0, 0, 1, 2, 0]
    assert apply(spark, lambda ws: w.skew_roll(F.col(X), 3, ws), x=[1.0, 1.0, 1.0]) == [None, None, 0]
    assert apply(spark, lambda ws: w.kurt_roll(F.col(X), 4, ws), x=[1.0] * 4) == [None, None, None, -3]
    assert apply(spark, lambda ws: w.std_roll(F.col(X), 2, ws, floor=1.0), x=[1.0, 1.0, 5.0]) == [None, 1, pytest.approx(8**0.5)]
    assert apply(spark, lambda ws: w.z_roll(F.col(X), 2, ws), x=[1.0, 1.0]) == [None, None]


def test_cross_section(spark):
    line = rows(spark, asset=[1, 2, 3, 4], date=[0, 0, 0, 0], i=[0, 1, 2, 3], x=[10.0, None, 30.0, 20.0])
    assert values(xsec.with_pct(line, F.col(X), "out")) == [0, None, 1, 0.5]
    assert close(values(xsec.with_pct(line, F.col(X), "out", older=True)), [0, None, 2 / 3, 1 / 3])
    assert values(xsec.with_pct(rows(spark, asset=[1], date=[0], i=[0], x=[1.0]), F.col(X), "out")) == [None]
    chosen = rows(spark, asset=[1, 2, 3, 4], date=[0] * 4, i=[0, 1, 2, 3], x=[5.0, 1.0, 3.0, 2.0], s=[True, False, True, True])
    assert values(xsec.with_top_n(chosen, F.col(X), F.col("s"), 2, "out")) == [False, False, True, True]
    weights = rows(spark, asset=[1, 2], date=[0, 0], i=[0, 1], b=[0.5, 0.5], a=[0.2, -0.1])
    assert close(values(xsec.add_alpha(weights, F.col("b"), F.col("a"), "out")), [1.5, 0])
    assert values(xsec.scale_row(rows(spark, asset=[1, 2], date=[0, 0], i=[0, 1], x=[2.0, 2.0]), F.col(X), "out")) == [None, None]
    tied = rows(spark, asset=[3, 1, 2], date=[0, 0, 0], x=[5.0, 5.0, 5.0])
    assert [r["asset"] for r in xsec.largest(tied, "x", 2).collect()] == [1, 2]


def test_regions(spark):
    """Regions may overlap: a cell counts once for each in which it ranks high; the second region cuts down both."""
    d_ = rows(spark, asset=[1, 2, 3, 4, 5], date=[0] * 5, x=[10.0, 40.0, 30.0, 20.0, 50.0], g=[True, True, True, False, True], h=[False, True, True, True, True], ok=[True, True, True, True, False])
    both = xsec.rank_select(d_, F.col("x"), [F.col("g"), F.col("h")], 1.0, 1.0, F.col("ok"), "out")
    assert values(both, order="asset") == [0, 2, 0, 0, 0]
    assert values(xsec.rank_select(d_, F.col("x"), [F.col("g"), F.col("h")], 0.0, 0.5, name="out"), order="asset") == [1, 0, 2, 1, 0]


def test_residuals(spark):
    rng = np.random.default_rng(1)
    a, b, y = rng.normal(size=(3, 20))
    df = rows(spark, asset=list(range(20)), date=[d.date(2020, 1, 1)] * 20, a=a.tolist(), b=b.tolist(), y=y.tolist())
    m = np.column_stack([a, b])
    want = y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
    got = xsec.residual_two(df, F.col("y"), F.col("a"), F.col("b"), "out")
    assert np.isclose(xsec.first_coefficient(df, "y", ["a", "b"]).first()["beta"], np.linalg.lstsq(m, y, rcond=None)[0][0])
    assert np.allclose(values(got, order="asset"), want)
    assert np.allclose(values(xsec.residual_many(df, "y", ["a", "b"]), "residual", "asset"), want)
    one = xsec.residual_one(df, F.col("y"), F.col("a"), "out")
    assert np.allclose(values(one, order="asset"), y - a * (a @ y) / (a @ a))


def test_residual_many_by_parts(spark):
    """No task gets all assets of a date: they meet as triangles. Collinear bases and dates without complete rows are as before."""
    rng = np.random.default_rng(4)
    n, day = 900, [d.date(2020, 1, 1 + k % 3) for k in range(900)]
    a, b, y = rng.normal(size=(3, n))
    a[[k for k in range(n) if k % 3 == 2]] = np.nan
    df = rows(spark, asset=list(range(n)), date=day, a=a.tolist(), b=b.tolist(), c=(2 * b).tolist(), y=y.tolist()).repartition(7)
    got = np.array([np.nan if v is None else v for v in values(xsec.residual_many(df, "y", ["a", "b", "c"]), "residual", "asset")])
    for k in range(3):
        assert np.allclose(got[k::3], linalg.residuals(y[k::3], np.column_stack([a, b, 2 * b])[k::3]), equal_nan=True)
    plan = xsec.residual_many(df, "y", ["a", "b"])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" in plan and plan.index("FlatMapGroupsInPandas") < plan.index("MapInPandas")


def test_ols():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(size=30) * 0.1
    beta, p = linalg.ols(y, x)
    assert np.allclose(beta, [1, 2, -1], atol=0.1) and (p < 1e-6).all()
    assert np.allclose(linalg.student_p(2.0, 10), 0.07338803477, atol=1e-9)
    assert np.allclose(linalg.student_p(1.0, 1), 0.5)
    beta, p = linalg.ols(np.ones(3), np.zeros((3, 5)))
    assert (beta == 0).all() and np.isnan(p).all()


def test_attribution(spark):
    """As least squares over each quarter's rows, whatever tasks they lie in; short, collinear and incomplete quarters; a null deal."""
    rng = np.random.default_rng(6)
    days = [d.date(2020, 1, 1) + d.timedelta(7 * k) for k in range(52)]
    f = rng.normal(size=(52, 5))
    f[13:26, 4] = 2 * f[13:26, 3]
    ret = {a: 0.3 + f @ [1, 0.5, -1, 0.2, 0] + rng.normal(size=52) for a in ("a", "b", None)}
    drop = {("b", k) for k in range(26, 35)}
    long = [(a, days[k], None if (a, k) == ("a", 40) else float(ret[a][k])) for a in ret for k in range(52) if (a, k) not in drop]
    fund = spark.createDataFrame(long, "deal string, date date, ret double").repartition(7)
    table = spark.createDataFrame([(days[k], *map(float, f[k])) for k in range(52)], "date date, rm double, smb double, hml double, rmw double, cma double")
    got = factors.attribution(fund, table, spark.createDataFrame([], "date date, rf double")).collect()
    assert len(got) == 3 * 4 * 6
    by = {(r["deal"], r["period"], r["term"]): r for r in got}
    for a in ret:
        for q in range(4):
            ks = [k for k in range(52) if (days[k].month - 1) // 3 == q and (a, k) not in drop]
            y = np.array([np.nan if (a, k) == ("a", 40) else ret[a][k] for k in ks])
            beta, p = linalg.ols(y, f[ks])
            first = days[ks[0]].replace(day=28) + d.timedelta(4)
            for j, term in enumerate(factors.TERMS):
                r = by[a, first - d.timedelta(first.day), term]
                assert np.isclose(r["beta"], beta[j], atol=1e-9) and (r["p_value"] is None if np.isnan(p[j]) else np.isclose(r["p_value"], p[j], atol=1e-9))


def test_shares(spark):
    two = rows(spark, g=[1, 1, 1, 2, 2], k=[0, 1, 2, 0, 1], wt=[0.25, 0.25, 0.5, 0.5, 0.5], t=[2, 2, 2, 3, 3])
    got = factors.integer_shares(two, "wt", "k", "g", F.col("t")).orderBy("g", "k").collect()
    assert [r["share"] for r in got] == [0, 0, 2, 1, 2]


def test_performance(spark):
    nav = rows(spark, series_id=["a"] * 5, date=[d.date(2020, 1, k) for k in range(1, 6)], nav=[1.0, 1.2, 0.9, 1.0, 1.3])
    r = performance.max_drawdown(nav).first()
    assert round(r["max_dd"], 4) == 0.3333 and r["longest_below"] == 2
    ret = rows(spark, series_id=["a"] * 3, date=[d.date(2020, 1, k) for k in range(1, 4)], nav=[0.1, -0.1, 0.0])
    assert performance.metrics(ret, is_return=True).first()["win_rate"] == 0.5
    three = rows(spark, series_id=["a"] * 3, date=[d.date(2020, 1, k) for k in range(1, 4)], nav=[100.0, 90.0, 99.0])
    got = performance.metrics(three).first()  # returns -0.1 and 0.1, the first value has none
    assert np.isclose(got["win_rate"], 1 / 3) and np.isclose(got["ann_ret"], 0) and np.isclose(got["ann_vol"], 0.1 * got["ann_fac"] ** 0.5) and got["n_data"] == 4
    bare = performance.metrics(three, dated=False).first()
    assert (bare["ann_fac"], bare["n_data"], bare["start"], bare["days"]) == (250, 3, None, None)


def test_trim(spark):
    def trimmed(x):
        return values(align.trim_idle(rows(spark, series_id=["a"] * len(x), i=list(range(len(x))), value=x)), "value")

    assert trimmed([1.0, 1.0, 2.0, 3.0, 3.0]) == [None, 1, 2, 3, None]
    assert trimmed([1.0, 1.0, 1.0]) == [None] * 3
    assert trimmed([None, 1.0, None, 2.0]) == [None, 1, None, 2]


def test_as_of(spark):
    day = [d.date(2020, 1, k) for k in range(1, 6)]
    obs = rows(spark, series_id=["a", "a"], time=[day[0], day[2]], value=[1.0, 3.0])
    got = align.as_of(obs, rows(spark, time=day), extend_last=False)
    assert values(got, "value", "time") == [1, 1, 3, None, None]
    assert values(align.as_of(obs, rows(spark, time=day)), "value", "time") == [1, 1, 3, 3, 3]
    assert values(align.as_of(obs, rows(spark, time=day)), "is_real", "time") == [True, False, True, False, False]
    at = align.last_known_index(rows(spark, series_id=["a"] * 3, target=[1, 5, 10]), rows(spark, series_id=["a"] * 3, source=[2, 4, 8]))
    assert values(at, "at", "target") == [-1, 1, 2]


@pytest.mark.parametrize("most", [1, 25, 1000])
def test_as_of_in_parts(spark, most):
    """One long and one short series, observations before, between and after the targets: as a plain search finds them."""
    rng = np.random.default_rng(5)
    obs = {"a": sorted(rng.choice(400, 150, replace=False).tolist()), "b": [7, 200], "c": [390]}
    targets = sorted(rng.choice(np.arange(50, 360), 60, replace=False).tolist())
    flat = [(s, t) for s, ts in obs.items() for t in ts]
    df = rows(spark, series_id=[s for s, _ in flat], time=[t for _, t in flat], value=[float(t) for _, t in flat])
    for extend in (True, False):
        got = {(r["series_id"], r["time"]): (r["value"], r["is_real"]) for r in align.as_of(df, rows(spark, time=targets), extend, most).collect()}
        assert len(got) == 3 * len(targets)
        for (s, t), (v, real) in got.items():
            known = [x for x in obs[s] if x <= t]
            late = [x for x in targets if x >= obs[s][-1]]
            keep = extend or t < obs[s][-1] or t == late[0]
            assert (v, real) == (float(known[-1]) if known and keep else None, t in obs[s] and keep)
    at = align.last_known_index(rows(spark, series_id=["a"] * 60, target=targets), rows(spark, series_id=["a"] * 150, source=obs["a"]), rows=most)
    assert values(at, "at", "target") == [sum(x <= t for x in obs["a"]) - 1 for t in targets]


def test_as_of_with_a_burst(spark):
    """Nine tenths of the rows in one hour: the parts follow the rows, not the time; and more targets than a calendar may have."""
    n = 3000
    burst = spark.range(n).select(F.lit("a").alias("series_id"), (F.when(F.col("id") < n * 0.9, 5000 + F.col("id") / 10000).otherwise(F.col("id") * 3)).alias("time"), F.col("id").cast("double").alias("value"))
    targets = spark.range(2000).select((F.col("id") * 5).cast("double").alias("time"))
    both = align._with_targets(burst, align.wanted(burst, targets), 200)
    assert both.df.groupBy("_part").count().agg(F.max("count")).first()[0] < 800
    got = {r["time"]: r["value"] for r in align.as_of(burst, targets, rows=200).collect()}
    seen = sorted((r["time"], r["value"]) for r in burst.collect())
    at = np.searchsorted([t for t, _ in seen], [5.0 * k for k in range(2000)], side="right") - 1
    assert [got[5.0 * k] for k in range(2000)] == [None if j < 0 else seen[j][1] for j in at]


def test_repeats_are_warned_of(spark):
    d_ = rows(spark, series_id=["a", "a", "a", "b"], time=[1, 1, 2, 1], value=[1.0, 1.0, 2.0, 3.0], n=[0, 1, 2, 3])
    with pytest.warns(UserWarning, match="1 rows of 1 series repeat a time, those of a among them"):
        assert align.drop_duplicates(d_, "n", keep="warn").count() == 4
    assert [tuple(r) for r in align.repeats(d_).collect()] == [("a", 1)]


def test_rules(spark):
    """Every day of 2023 and 2024 but weekends: rules by hand."""
    days = [d.date(2023, 1, 1) + d.timedelta(k) for k in range(731)]
    days = [x for x in days if x.weekday() < 5]
    cal = rows(spark, date=days)
    on = lambda *a, **k: [r["date"] for r in panel.dates_by_rule(cal, *a, **k).filter("flag").orderBy("date").collect()]
    first = [min(x for x in days if (x.year, x.month) == m) for m in sorted({(x.year, x.month) for x in days})]
    known = first[1:]  # the first of January 2023 lies before the calendar
    assert on("mm/1") == known and on("mm/1", 3) == [days[days.index(x) + 2] for x in known]
    week = lambda x: int(x.strftime("%W")) - int(x.replace(day=1).strftime("%W")) + 1
    fourth = [min(x for x in days if (x.year, x.month) == (f.year, f.month) and week(x) >= 4 and x.weekday() >= 3) for f in first]
    assert on("ww4-3") == fourth and all(x.weekday() >= 3 for x in fourth)
    may = [min(x for x in days if x >= d.date(y, 5, 15)) for y in (2023, 2024)]
    assert on("yy/5/15mm/1") == on(["yy/5/15", "mm/1"]) == sorted({*may, *known})
    assert on(["mm/24", "ww4-3"], every=True) == sorted({*on("mm/24")} & {*fourth}) != []
    assert on(["mm/24", "ww4-3", "yy/5/15"], every=True) == []
    with pytest.raises(ValueError):
        on("dd/1")


def test_wanted_assets(spark):
    d_ = rows(spark, asset=[1, 1, 2], date=[1, 2, 1], x=[1.0, None, 3.0])
    got = panel.wanted_assets(d_, rows(spark, asset=[1, 9]), ["x"], 0.5)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1.0), (1, 2, None), (9, 1, 0.5), (9, 2, 0.5)]


def test_merge(spark):
    day = [d.date(2020, 1, k) for k in range(1, 4)]
    new = rows(spark, series_id=["a", "a"], time=day[:2], value=[1.0, 2.0])
    old = rows(spark, series_id=["a", "a"], time=day[1:], value=[2.1, 3.0])
    merged = align.merge(new, old)
    assert values(merged, "value", "time") == [1, 2, 3]
    assert tuple(align.merge_summary(merged).first())[1:] == (1, 1, 1, 0)
    assert values(align.merge(new, old, "use_old"), "value", "time") == [1, 2.1, 3]
    with pytest.raises(ValueError):
        align.merge(old, new, "raise")
    with pytest.raises(ValueError):
        align.merge_into(new.union(new), old)
    assert values(align.new_information(new, old), "value", "time") == [1, 2]
    zero = rows(spark, series_id=["a"] * 3, time=day, value=[0.0, 0.0, 0.0])
    grown = align.merge(rows(spark, series_id=["a"] * 3, time=day, value=[5.0, 0.0, -5.0]), zero)
    assert values(grown, "flagged", "time") == [True, False, False]
    with pytest.raises(ValueError):
        align.merge(rows(spark, series_id=["a"], time=day[:1], value=[5.0]), zero, "raise")


def test_duplicates(spark):
    twice = rows(spark, series_id=["a", "a", "a"], time=[1, 1, 1], value=[1.0, 1.0, 2.0], n=[3, 1, 2])
    assert sorted(r["n"] for r in align.drop_duplicates(twice, "n").collect()) == [1, 2]
    assert [tuple(r) for r in align.drop_duplicates(twice, "n", "last", whole_rows=False).collect()] == [("a", 1, 1.0, 3)]


def test_dates(spark):
    one = rows(spark, t=["43831", "2020/1/5", "20200105", "737791", "2020-1-5 7:30", "x"])
    got = one.select("t", dates.guess_format(F.col("t")).alias("k"), dates.any_time(F.col("t")).cast("string").alias("d")).collect()
    assert {r["t"]: (r["k"], r["d"]) for r in got} == {
        "43831": ("excel", "2020-01-01 00:00:00"),
        "2020/1/5": ("y/m/d", "2020-01-05 00:00:00"),
        "20200105": ("yyyymmdd", "2020-01-05 00:00:00"),
        "737791": ("matlab", "2020-01-01 00:00:00"),
        "2020-1-5 7:30": ("y-m-d h:m", "2020-01-05 07:30:00"),
        "x": ("unknown", None),
    }
    day = rows(spark, d=[d.date(2024, 1, 3)])
    assert day.select(dates.next_weekday(F.col("d"), 3)).first()[0] == d.date(2024, 1, 10)
    clock = rows(spark, a=["20200105"], b=["93001"])
    assert str(clock.select(dates.parse_time(F.col("a"), F.lit("yyyymmdd"), F.col("b")).cast("string")).first()[0]) == "2020-01-05 09:30:01"


def test_calendar(spark):
    cal = rows(spark, date=[d.date(2020, 1, k) for k in (2, 3, 6, 7)])
    cells_ = rows(spark, asset=[1, 1, 1], date=[d.date(2020, 1, 2), d.date(2020, 1, 4), d.date(2020, 1, 7)], x=[1.0, 9.0, 2.0])
    assert values(panel.align_force(cells_, cal, ["x"]), "x", "date") == [1, 1, 1, 2]
    kept = panel.align_keep(cells_.select("date", "x"), cal)
    assert values(kept, "added", "date") == [False, True, False, True, False]
    assert values(panel.dates_by_rule(cal, "mm/1", 2), "flag", "date") == [False] * 4
    assert values(panel.dates_by_rule(cal, "mm/3", 2), "flag", "date") == [False, False, True, False]
    with pytest.raises(ValueError):
        panel.check_same_shape({"a": rows(spark, asset=[1], date=[1], value=[1.0]), "b": rows(spark, asset=[2], date=[1], value=[1.0])})


def test_text(spark):
    p = rows(spark, p=["C:\\data\\x\\fund.1.csv", "a/b/c", "plain"])
    got = p.select(text.file_name(F.col("p")), text.file_extension(F.col("p")), text.proper_name(F.col("p")), text.folder_name(F.col("p")), text.levels_up(F.col("p"), 1)).collect()
    assert [tuple(r) for r in got] == [("fund.1.csv", "csv", "fund.1", "x", "C:/data/x"), ("c", "", "c", "b", "a/b"), ("plain", "", "plain", "", "plain")]


def test_cells(spark):
    c = rows(spark, x=[1.0, float("nan"), None, 0.0])
    assert [r[0] for r in c.select(cells.replace(F.col("x"), None, 7.0)).collect()] == [1, 7, 7, 0]
    assert [r[0] for r in c.select(cells.missing(F.col("x"))).collect()] == [False, True, True, False]
    assert [r[0] for r in c.select(cells.divide(F.lit(1.0), F.col("x"), 2.0)).collect()][3] == 0.5


def test_graph(spark):
    tasks = rows(spark, task=["a", "b", "c"], depends_on=["", "a", "a, b"])
    e = graph.edges(tasks)
    assert {tuple(r) for r in e.collect()} == {("b", "a"), ("c", "a"), ("c", "b")}
    assert {tuple(r) for r in graph.impact(tasks.select("task"), e).collect()} == {("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c")}
    assert {r["task"]: r["level"] for r in graph.levels(tasks.select("task"), e).collect()} == {"a": 0, "b": 1, "c": 2}
    order = rows(spark, task=["a", "b", "c"], position=[2, 1, 3])
    assert {tuple(r) for r in graph.violations(order, e).collect()} == {("b", "a")}
    same = rows(spark, task=["a", "z"], group_no=[1, 1])
    mate = rows(spark, task=["z", "b", "c", "a"], position=[0, 1, 3, 2])
    assert graph.violations(mate, e, same).isEmpty()
    with pytest.raises(ValueError):
        graph.edges(rows(spark, task=["a"], depends_on=["q"]))
    with pytest.raises(ValueError):
        circle = rows(spark, task=["a", "b"], depends_on=["b", "a"])
        graph.impact(circle.select("task"), graph.edges(circle))
    with pytest.raises(ValueError):
        graph.levels(circle.select("task"), graph.edges(circle))


def test_long_chain(spark):
    """A chain of 500 tasks is no circle, however many rounds one edge at a time would take."""
    tasks = rows(spark, task=[str(k) for k in range(500)], depends_on=["", *(str(k) for k in range(499))])
    e = graph.edges(tasks)
    assert {r["task"]: r["level"] for r in graph.levels(tasks.select("task"), e).collect()} == {str(k): k for k in range(500)}
    assert graph.impact(tasks.select("task"), e).count() == 500 * 501 // 2


def test_impact_in_bounded_tasks(spark, monkeypatch):
    """More paths are more tasks, not longer ones: no part of what a round leaves holds much more than ROWS."""
    monkeypatch.setattr(graph, "ROWS", 500, raising=False)
    most, cut = [], graph.cut

    def counted(df):
        out = cut(df)
        if "affects" in out.columns:
            most.append(max((r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()), default=0))
        return out

    monkeypatch.setattr(graph, "cut", counted)
    deps = {k: {j for j in (k // 10, k // 15) if j} for k in range(2000)}
    tasks = rows(spark, task=[str(k) for k in deps], depends_on=[",".join(map(str, v)) for v in deps.values()])
    got = sorted(tuple(map(int, r)) for r in graph.impact(tasks.select("task"), graph.edges(tasks)).collect())
    assert got == _reached(deps)
    assert max(most) < 2 * 500


def test_impact_through_a_hub(spark, monkeypatch):
    """All paths lead over one task: they are dealt out, whichever side is longer, and none is lost or doubled."""
    monkeypatch.setattr(graph, "ROWS", 500, raising=False)
    sizes, longer = [], graph._longer

    def counted(*args):
        out = longer(*args)
        sizes.extend(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        return out

    monkeypatch.setattr(graph, "_longer", counted)
    for before, after in ((20, 400), (400, 20)):
        hub = before
        deps = {k: set() for k in range(before)} | {hub: set(range(before))} | {k: {hub} for k in range(hub + 1, hub + 1 + after)}
        tasks = rows(spark, task=[str(k) for k in deps], depends_on=[",".join(map(str, v)) for v in deps.values()])
        sizes.clear()
        got = sorted(tuple(map(int, r)) for r in graph.impact(tasks.select("task"), graph.edges(tasks)).collect())
        assert got == _reached(deps)
        assert sum(sizes) == before * after and max(sizes) < 4 * 500


def test_impact_over_ways_of_unlike_length(spark):
    rng = np.random.default_rng(5)
    for n, density in ((12, 0.5), (40, 0.08), (60, 0.03)):
        deps = {k: {j for j in range(k) if rng.random() < density} for k in range(n)}
        tasks = rows(spark, task=[str(k) for k in deps], depends_on=[", ".join(map(str, [*v, *v])) for v in deps.values()])
        got = sorted(tuple(map(int, r)) for r in graph.impact(tasks.select("task"), graph.edges(tasks)).collect())
        assert got == _reached(deps)
    for length in (1, 3, 5, 6):
        names = [*(str(k) for k in range(length)), "in", "out"]
        circle = rows(spark, task=names, depends_on=[*(f"{(k + 1) % length}" + ",in" * (k == 0) for k in range(length)), "", "0"])
        with pytest.raises(ValueError):
            graph.impact(circle.select("task"), graph.edges(circle))


def _reached(deps):
    """(task, affects), by walking up from each task; those it depends on have smaller numbers."""
    above = {}
    for k in sorted(deps):
        above[k] = {k}.union(*(above[j] for j in deps[k]))
    return sorted((j, k) for k, v in above.items() for j in v)


def test_grouping():
    m = np.array([[1, 0.9, 0.1, 0.0], [0.9, 1, 0.2, 0.1], [0.1, 0.2, 1, 0.8], [0.0, 0.1, 0.8, 1]])
    assert [sorted(g.tolist()) for g in cluster.one_level(m, 0.5)] == [[0, 1], [2, 3]]
    assert [p[:1] for _, p in cluster.tree_order(m, [0.5])] == [(0,), (0,), (1,), (1,)]
    assert len(cluster.tree_order(m)) == 4


def test_threshold():
    """The best of twenty-one thresholds, by loops over the definition."""
    rng = np.random.default_rng(11)
    for n in (6, 9, 12):
        m = np.corrcoef(rng.normal(size=(n, 8)) + 2 * rng.normal(size=(3, 8))[np.arange(n) % 3])
        scores = []
        for t in [m.min() + k * (m.max() - m.min()) / 20 for k in range(21)]:
            groups = _groups(m.tolist(), t)
            inside = [m[i, j] for g in groups for i in g for j in g]
            scores.append((t, sum(inside) / len(inside), len(groups)))
        unit = lambda k, v: (v - min(s[k] for s in scores)) / (max(s[k] for s in scores) - min(s[k] for s in scores))
        best = max(unit(1, s[1]) - unit(2, s[2]) for s in scores)
        assert any(np.isclose(s[0], cluster.best_threshold(m)) and np.isclose(unit(1, s[1]) - unit(2, s[2]), best) for s in scores)


def test_correlation(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3, 12))
    long = [(s, i, float(x[s, i])) for s in range(3) for i in range(12) if (s, i) != (1, 4)]
    got = {(r["a"], r["b"]): r["corr"] for r in cluster.pairwise(spark.createDataFrame(long, "series_id int, i long, ret double")).collect()}
    keep = [i for i in range(12) if i != 4]
    assert np.isclose(got[0, 1], np.corrcoef(x[0, keep], x[1, keep])[0, 1]) and got[0, 2] == got[2, 0]
    blocked = cluster.pairwise_blocked(spark.createDataFrame(long, "series_id int, i long, ret double"), 2)
    assert {k: round(v, 12) for k, v in got.items()} == {(r["a"], r["b"]): round(r["corr"], 12) for r in blocked.collect()}
    alone = cluster.pairwise(spark.createDataFrame([(0, 1, 1.0), (1, 1, 2.0)], "series_id int, i long, ret double"))
    assert {r["corr"] for r in alone.collect()} == {-1.0}


def _groups(m, threshold):
    """One level, by loops over the definitions."""
    left, out = list(range(len(m))), []
    while left:
        mean = [sum(m[i][j] for j in left) / len(left) for i in left]
        group = [left[mean.index(max(mean))]]
        while True:
            fit = [(sum(m[i][j] for j in group) / len(group), -i) for i in left if i not in group and min(m[i][j] for j in group) > threshold]
            if not fit:
                break
            group.append(-max(fit)[1])
        out.append(group)
        left = [i for i in left if i not in group]
    return out


def test_grouping_by_universe(spark):
    """Universes are grouped each by itself, as plain loops do."""
    rng = np.random.default_rng(7)
    flat, want, best = [], [], {}
    for u, n in (("x", 7), ("y", 5), ("z", 1)):
        m = np.corrcoef(rng.normal(size=(n, 6)) + rng.normal(size=6)).reshape(n, n)
        flat += [(u, i, j, float(m[i, j])) for i in range(n) for j in range(n)]
        want += [(u, [g[k]], gi) for gi, g in enumerate(_groups(m.tolist(), 0.3)) for k in range(len(g))]
        best[u] = m.min() if n == 1 else None
    pairs = spark.createDataFrame(flat, "u string, a int, b int, corr double").repartition(5)
    got = cluster.grouped(pairs, [0.3], "u").orderBy("u", "order_no").collect()
    assert [(r["u"], [r["series_id"]], r["path"][0]) for r in got] == want
    assert {r["u"] for r in cluster.chosen_threshold(pairs, "u").collect()} == {"x", "y", "z"}
    order = cluster.grouped(pairs, universe="u")
    assert cluster.sorted_matrix(pairs, order, "u").count() == 49 + 25 + 1
    corr = {(u, a, b): c for u, a, b, c in flat}
    for u in "xyz":
        names = [r["series_id"] for r in order.filter(F.col("u") == u).orderBy("order_no").collect()]
        rows_ = cluster.matrix_rows(cluster.sorted_matrix(pairs, order, "u"), "u").filter(F.col("u") == u).orderBy("row_no").collect()
        assert [r["a"] for r in rows_] == names and [r["corr"] for r in rows_] == [[corr[u, a, b] for b in names] for a in names]


def test_blocked_by_universe(spark):
    rng = np.random.default_rng(9)
    long = [(u, s, i, float(rng.normal())) for u in ("p", "q") for s in range(4) for i in range(9)]
    df = spark.createDataFrame(long, "u string, series_id int, i long, ret double")
    for blocks in (None, 3):
        got = {(r["u"], r["a"], r["b"]): r["corr"] for r in cluster.pairwise_blocked(df, blocks, "u").collect()}
        x = {u: np.array([[v for w_, s_, i, v in long if (w_, s_) == (u, s)] for s in range(4)]) for u in "pq"}
        assert len(got) == 32 and all(np.isclose(c, np.corrcoef(x[u][a], x[u][b])[0, 1]) for (u, a, b), c in got.items())


def _rescaled(m):
    """By the closed form: a series' scale is the level at its last start over its own value there; the level is that of the main series, which has the scale of its start before."""
    dates, n = m.shape
    there = [[i for i in range(dates) if not np.isnan(m[i, s])] for s in range(n)]
    starts = [[i for i in t if i - 1 not in t] for t in there]
    main, level = {}, {}
    for i in range(dates):
        kept = main.get(i - 1)
        if kept is None or i not in there[kept]:
            steps = {s: (m[there[s][-1], s] - m[i, s]) / (there[s][-1] + 1 - i) for s in range(n) if i in there[s]}
            kept = min(steps, key=lambda s: (abs(steps[s] - np.mean(list(steps.values()))), s)) if steps else None
        main[i] = kept
        if kept is not None:
            before = [k for k in starts[kept] if k < i]
            level[i] = m[i, kept] * (level[before[-1]] / m[before[-1], kept] if before else 1)
    return np.column_stack([m[:, s] * (level[starts[s][-1]] / m[starts[s][-1], s] if starts[s] else np.nan) for s in range(n)])


def test_rescaled_by_series(spark):
    """With gaps and restarts, and without a matrix of all series in one task."""

    def got(m):
        long = [(s, 2 * i, None if np.isnan(m[i, s]) else float(m[i, s])) for i in range(m.shape[0]) for s in range(m.shape[1])]
        df, out = spark.createDataFrame(long, "series_id int, i long, value double"), np.full(m.shape, np.nan)
        for r in cluster.rescaled(df).collect():
            out[r["i"] // 2, r["series_id"]] = np.nan if r["value"] is None else r["value"]
        return df, out

    small = np.array([[1.0, np.nan], [2.0, 10.0], [3.0, 15.0]])
    assert np.allclose(got(small)[1], [[1, np.nan], [2, 2], [3, 3]], equal_nan=True)
    rng = np.random.default_rng(8)
    m = rng.uniform(1, 9, size=(30, 25))
    m[rng.random(m.shape) < 0.25] = np.nan
    m[:9, :6], m[3, :], m[:, 7] = np.nan, np.nan, np.nan
    df, out = got(m)
    assert np.allclose(out, _rescaled(m), equal_nan=True)
    twice = df.withColumn("u", F.lit("a")).unionByName(df.withColumn("u", F.lit("b")).withColumn("series_id", F.col("series_id") + 100))
    assert cluster.rescaled(twice, "u").filter("series_id >= 100").count() == m.size


def test_poly(spark):
    x = np.linspace(-2, 5, 40)
    df = rows(spark, g=["a"] * 40, x=x.tolist(), y=(1 + 2 * x - 0.5 * x**3).tolist())
    c = factors.poly_fit(df, "x", "y", "g").first()
    assert np.allclose([c["c0"], c["c1"], c["c2"], c["c3"]], [1, 2, 0, -0.5])


def test_empty(spark):
    none = rows(spark, series_id=["a"], time=[d.date(2020, 1, 1)], value=[1.0]).filter("false")
    assert align.merge(none, none).isEmpty() and align.as_of(none, none.select("time")).isEmpty()
    assert panel.densify(rows(spark, asset=[1], date=[1], x=[1.0]).filter("false")).isEmpty()

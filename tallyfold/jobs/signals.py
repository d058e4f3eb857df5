"""Queries on shifts, fills, states and rolling statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tallyfold.functions import cells as c
from tallyfold.jobs.panels import STOCK, stock, table
from tallyfold.jobs.registry import query, r, rs
from tallyfold.operators import windows as w
from tallyfold.operators.ordered import rolling
from tallyfold.operators.panel import fill_columns, wanted_assets


def x() -> Column:
    return F.col("close")


def i() -> Column:
    return F.col("i")


def high() -> Column:
    return F.col("roe") > 0.04


_WINDOWS = "WINDOW wa AS (PARTITION BY asset ORDER BY i), so_far AS (PARTITION BY asset ORDER BY i ROWS UNBOUNDED PRECEDING), before AS (PARTITION BY asset ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _add(name: str, before: int = 0, after: int = 0, **columns: tuple[Callable[[WindowSpec | None], Column], str]) -> None:
    """A query of the stock panel with columns given in Spark and in SQL. In Spark they look at so many rows before and after, over a window v."""
    sql = ", ".join(f"{s} AS {k}" for k, (_, s) in columns.items())

    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        d, make = stock(spark, sf_dir), lambda v: {k: col(v) for k, (col, _) in columns.items()}
        d = rolling(d, make, before, after) if before or after else d.select("*", *[c.alias(k) for k, c in make(None).items()])
        return d.select("asset", "date", *columns)

    query(name, f"WITH {STOCK} SELECT asset, date, {sql} FROM stock {_WINDOWS}")(made)


def _add_frame(name: str, column: str, made: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query of the stock panel with a column that is carried from the first row on."""
    query(name, f"WITH {STOCK} SELECT asset, date, {sql} AS {column} FROM stock {_WINDOWS}")(lambda spark, sf_dir: made(stock(spark, sf_dir)).select("asset", "date", column))


def _frame(n: int) -> str:
    return f"(PARTITION BY asset ORDER BY i ROWS {n - 1} PRECEDING)"


def _full(expression: str, n: int, least: int | None = None, x: str = "close") -> str:
    return f"CASE WHEN count({x}) OVER {_frame(n)} >= {least or n} THEN {expression} OVER {_frame(n)} END"


_CHANGE = "coalesce(close / lag(close) OVER wa - 1, 0)"
_HIGH = "coalesce(roe > 0.04, false)"

_add("R1_ref", before=2, after=1, back=(lambda v: w.ref(x(), 2, v, -1.0), "lag(close, 2, -1.0) OVER wa"), ahead=(lambda v: w.ref(x(), -1, v), "lead(close) OVER wa"), same=(lambda v: w.ref(x(), 0, v), "close"))
_add("R2_reldiff", before=1, ret=(lambda v: r(w.reldiff(x(), v)), rs(_CHANGE)))
_add("R3_diff", before=1, d=(lambda v: r(w.diff(x(), v)), rs("coalesce(close - lag(close, 1, 0.0) OVER wa, 0)")))
_add("R4_nav2ret", before=1, ret=(lambda v: r(w.nav2ret(x(), i(), v, 0.5)), f"CASE WHEN i = 0 THEN 0.5 ELSE {rs('close / lag(close) OVER wa - 1')} END"))
_add_frame("R6_ffill", "filled", lambda d: w.ffill(d, {"filled": x()}), "last_value(close IGNORE NULLS) OVER so_far")
_add_frame(
    "R7_pause",
    "held",
    lambda d: w.pause(d, x(), F.pmod(i(), F.lit(3)) == 0),
    "CASE WHEN last_value(CASE WHEN i % 3 != 0 THEN {'v': close} END IGNORE NULLS) OVER so_far IS NULL THEN 0.0 ELSE (last_value(CASE WHEN i % 3 != 0 THEN {'v': close} END IGNORE NULLS) OVER so_far).v END",
)
_add("R8_trade_rows", trade=(lambda v: w.trade_rows(i(), 6, 4), "i >= 3 AND (i - 3) % 6 = 0"))
_carried = lambda take: f"(last_value(CASE WHEN i = 0 OR {take} THEN {{'v': close}} END IGNORE NULLS) OVER so_far).v"
_add_frame("R9_reduce_freq", "held", lambda d: w.reduce_freq(d, x(), 3, 2), _carried("(i >= 1 AND (i - 1) % 3 = 0)"))
_add_frame("R10_reduce_freq_older", "held", lambda d: w.reduce_freq_older(d, x(), 3), _carried("i % 4 = 0"))
_add_frame(
    "R11_reduce_freq_staggered",
    "held",
    lambda d: w.reduce_freq_staggered(d, x(), 6, 3, "mean").withColumn("held", r("mean")),
    rs("(" + " + ".join(_carried(f"(i >= {s - 1} AND (i - {s - 1}) % 6 = 0)") for s in (1, 3, 4)) + ") / 3"),
)
_add("R12_shift_return", before=1, ret=(lambda v: r(w.shift_return(w.reldiff(x(), v), F.col("date"), 0.02, v), 8), rs(f"{_CHANGE} + 0.02 * coalesce(date - lag(date) OVER wa, 0) / 365.25", 8)))
_SINCE = f"CAST(coalesce(i - 1 - max(CASE WHEN {_HIGH} THEN i END) OVER before, i) AS BIGINT)"
_add_frame("R13_bars_since", "bars", lambda d: w.bars_since(d, high()), _SINCE)
_add_frame("R14_bars_held", "bars", lambda d: w.bars_held(d, F.when(i() > 2, x())), "CAST(coalesce(i - min(CASE WHEN i > 2 AND close IS NOT NULL THEN i END) OVER so_far + 1, 0) AS BIGINT)")
_add("P13_cross", before=1, crossed=(lambda v: w.cross(x(), r(F.col("roe") * 40000), v), f"coalesce(lag(close < {rs('roe * 40000')}) OVER wa, false) AND coalesce(close >= {rs('roe * 40000')}, false)"))
_add("P14_mark_neighbors", before=1, after=1, near=(lambda v: w.mark_neighbors(x().isNull(), 1, v), "bool_or(close IS NULL) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"))

_add("W1_ma", before=5, ma=(lambda v: r(w.ma(x(), 6, v)), rs(_full("avg(close)", 6))), loose=(lambda v: r(w.ma(x(), 6, v, 1)), rs(_full("avg(close)", 6, 1))))
_add("W2_min_roll", before=5, low=(lambda v: w.min_roll(x(), 6, v), _full("min(close)", 6, 1)))
_add("W3_max_roll", before=5, high=(lambda v: w.max_roll(x(), 6, v), _full("max(close)", 6, 1)), strict=(lambda v: w.max_roll(x(), 6, v, 6), _full("max(close)", 6)))
_add("W4_sum_roll", before=4, total=(lambda v: r(w.sum_roll(F.col("qty"), 5, v)), rs(_full("sum(qty)", 5, 5, "qty"))), loose=(lambda v: r(w.sum_roll(F.col("qty"), 5, v, 3)), rs(_full("sum(qty)", 5, 3, "qty"))))
_add("W5_all_roll", before=1, every=(lambda v: w.all_roll(high(), 2, v), f"coalesce(sum(CAST({_HIGH} AS INT)) OVER {_frame(2)} = 2, false)"))
_add("W6_std_roll", before=7, std=(lambda v: r(w.std_roll(x(), 8, v)), rs(_full("stddev_samp(close)", 8))), floored=(lambda v: r(w.std_roll(x(), 8, v, 500.0)), rs(f"greatest({_full('stddev_samp(close)', 8)}, CASE WHEN count(close) OVER {_frame(8)} >= 8 THEN 500.0 END)")))
_add("W7_skew_roll", before=9, skew=(lambda v: r(w.skew_roll(x(), 10, v), 5), rs(_full("skewness(close)", 10), 5)))
_add("W8_kurt_roll", before=9, kurt=(lambda v: r(w.kurt_roll(x(), 10, v), 5), rs(_full("kurtosis(close)", 10), 5)))
_add("W9_z_roll", before=7, z=(lambda v: r(w.z_roll(x(), 8, v)), rs(f"CASE WHEN count(close) OVER {_frame(8)} >= 8 THEN (close - avg(close) OVER {_frame(8)}) / stddev_samp(close) OVER {_frame(8)} END")))
_pair = lambda y, x: rs(f"CASE WHEN count(CASE WHEN close IS NOT NULL AND roe IS NOT NULL THEN 1 END) OVER {_frame(6)} = 6 THEN regr_slope({y}, {x}) OVER {_frame(6)} END", 3 if y == "close" else 9)
_add("W10_corr_roll", before=5, slope=(lambda v: r(w.slope_roll(F.col("roe"), x(), 6, v), 9), _pair("roe", "close")))
_add("W11_regress_roll", before=5, beta=(lambda v: r(w.slope_roll(x(), F.col("roe"), 6, v), 3), _pair("close", "roe")))
_best = lambda v: f"CAST(i - (max(CASE WHEN close IS NOT NULL THEN {{'v': {v}, 'i': i}} END) OVER {_frame(5)}).i AS BIGINT)"
_add("W12_argmax_roll", before=4, rows=(lambda v: w.rows_since_max(x(), i(), 5, v), _best("close")))
_add("W13_argmin_roll", before=4, rows=(lambda v: w.rows_since_min(x(), i(), 5, v), _best("-close")))
_add("W14_count", before=5, n=(lambda v: w.count_true(high(), 6, v), f"CASE WHEN count(*) OVER {_frame(6)} = 6 THEN CAST(sum(CAST({_HIGH} AS BIGINT)) OVER {_frame(6)} AS BIGINT) END"))

_add("P1_missing", is_missing=(lambda v: c.missing(x()), "close IS NULL"), is_there=(lambda v: ~c.missing(x()), "close IS NOT NULL"))
_add("P2_replace", zeroed=(lambda v: c.replace(x(), None, 0.0), "coalesce(close, 0.0)"), masked=(lambda v: c.replace_where(x(), high(), -1.0), f"CASE WHEN {_HIGH} THEN -1.0 ELSE close END"))
_add("P3_divide", q=(lambda v: r(c.divide(x(), F.pmod(i(), F.lit(3)).cast("double"))), rs("close / CASE WHEN i % 3 = 0 THEN NULL ELSE i % 3 END")), q2=(lambda v: r(c.divide(x(), F.pmod(i(), F.lit(3)).cast("double"), 2.0)), rs("close / CASE WHEN i % 3 = 0 THEN 2.0 ELSE i % 3 END")))
_add("P4_max_pair", larger=(lambda v: c.larger(F.col("pb_ratio"), F.col("roe")), "CASE WHEN pb_ratio IS NOT NULL AND roe IS NOT NULL THEN greatest(pb_ratio, roe) END"))
_add("P5_as_number", value=(lambda v: c.as_number(F.when(high(), x())), f"coalesce(CASE WHEN {_HIGH} THEN close END, 0.0)"))
_add("P7_keep_flagged_column", kept=(lambda v: F.when(c.is_true(high()), x()), f"CASE WHEN {_HIGH} THEN close END"))


@query("P8_fill_columns", f"WITH {STOCK} SELECT asset, date, roe, CAST(0.0 AS DOUBLE) AS absent, close FROM stock")
def _(spark, sf_dir):
    return fill_columns(stock(spark, sf_dir), ["asset", "date", "roe", "absent", "close"], 0.0)


@query(
    "P8_wanted_assets",
    f"WITH {STOCK}, want AS (SELECT s_suppkey AS asset FROM supplier WHERE s_suppkey % 7 = 0 UNION SELECT s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 11 = 0) "
    "SELECT w.asset, d.date, CASE WHEN s.asset IS NULL THEN -1.0 ELSE s.close END AS close FROM want w CROSS JOIN (SELECT DISTINCT date FROM stock) d LEFT JOIN stock s ON s.asset = w.asset AND s.date = d.date",
)
def _(spark, sf_dir):
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    want = s.filter(key % 7 == 0).select(key.alias("asset")).unionByName(s.filter(key % 11 == 0).select((key + 1000000).alias("asset")))
    return wanted_assets(stock(spark, sf_dir), want, ["close"], -1.0)


@query("P7_keep_flagged", f"WITH {STOCK} SELECT asset, date, close FROM stock WHERE NOT {_HIGH}")
def _(spark, sf_dir):
    return stock(spark, sf_dir).filter(~c.is_true(high())).select("asset", "date", "close")


@query("P9_apply_across_time", f"WITH {STOCK} SELECT asset, date, {rs('close / m')} AS rel FROM stock JOIN (SELECT asset, max(close) AS m FROM stock GROUP BY 1) USING (asset)")
def _(spark, sf_dir):
    d = stock(spark, sf_dir)
    return d.join(d.groupBy("asset").agg(F.max("close").alias("m")), "asset").select("asset", "date", r(F.col("close") / F.col("m")).alias("rel"))


@query("P10_apply_across_asset", f"WITH {STOCK} SELECT asset, date, {rs('close / m')} AS rel FROM stock JOIN (SELECT date, max(close) AS m FROM stock GROUP BY 1) USING (date)")
def _(spark, sf_dir):
    d = stock(spark, sf_dir)
    return d.join(d.groupBy("date").agg(F.max("close").alias("m")), "date").select("asset", "date", r(F.col("close") / F.col("m")).alias("rel"))


@query("P12_fresh_report", "SELECT l_orderkey, l_linenumber, (CAST(l_shipdate AS DATE) - DATE '1899-12-30') - (CAST(l_shipdate AS DATE) - make_date(year(l_shipdate) - 1, 12, 31)) * (l_linenumber % 2) = make_date(year(l_shipdate) - 1, 12, 31) - DATE '1899-12-30' AS fresh FROM lineitem")
def _(spark, sf_dir):
    day = F.col("l_shipdate").cast("date")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")) - F.datediff(day, F.make_date(F.year(day) - 1, F.lit(12), F.lit(31))) * F.pmod("l_linenumber", F.lit(2))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c.fresh_annual_report(serial, day).alias("fresh"))


@query("R5_ref_dynamic", f"WITH {STOCK} SELECT s.asset, s.date, CASE WHEN p.asset IS NULL THEN -1.0 ELSE p.close END AS ref FROM stock s LEFT JOIN stock p ON p.asset = s.asset AND p.i = s.i - (s.i % 4)")
def _(spark, sf_dir):
    d = stock(spark, sf_dir).withColumn("n", F.pmod("i", F.lit(4)))
    return w.ref_dynamic(d, "close", "n", fill=-1.0).select("asset", "date", "ref")


@query(
    "R15_age",
    f"WITH {STOCK}, m AS (SELECT asset, date, i, {_HIGH} AS m, coalesce({_HIGH} != lag({_HIGH}) OVER (PARTITION BY asset ORDER BY i), false) AS changed FROM stock), "
    "g AS (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY asset ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM m) "
    "SELECT asset, date, (row_number() OVER (PARTITION BY asset, run ORDER BY i) - 1) * CASE WHEN m THEN 1 ELSE -1 END AS age FROM g",
)
def _(spark, sf_dir):
    return w.with_age(stock(spark, sf_dir), high()).select("asset", "date", "age")


@query(
    "W15_dynamic_sum",
    f"WITH {STOCK}, s AS (SELECT asset, date, i, (i * 7 + asset) % 5 AS n, sum(coalesce(qty, 0)) OVER (PARTITION BY asset ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM stock) "
    f"SELECT a.asset, a.date, {rs('CASE WHEN a.n = 0 OR a.i - a.n = -1 THEN a.s WHEN a.i - a.n >= 0 THEN a.s - b.s END')} AS sum FROM s a LEFT JOIN s b ON b.asset = a.asset AND b.i = a.i - a.n",
)
def _(spark, sf_dir):
    d = stock(spark, sf_dir).withColumn("n", F.pmod(F.col("i") * 7 + F.col("asset"), F.lit(5)))
    return w.with_dynamic_sum(d, F.col("qty"), "n").select("asset", "date", r("sum").alias("sum"))


@query(
    "W16_count_since",
    f"WITH {STOCK}, s AS (SELECT asset, date, i, sum(CAST(coalesce(pb_ratio > 0.05, false) AS BIGINT)) OVER (PARTITION BY asset ORDER BY i ROWS UNBOUNDED PRECEDING) AS s, "
    f"coalesce(i - 1 - max(CASE WHEN {_HIGH} THEN i END) OVER (PARTITION BY asset ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), i) AS n FROM stock) "
    "SELECT a.asset, a.date, CAST(CASE WHEN a.n = 0 THEN a.s ELSE a.s - b.s END AS BIGINT) AS count_since FROM s a LEFT JOIN s b ON b.asset = a.asset AND b.i = a.i - a.n",
)
def _(spark, sf_dir):
    return w.with_count_since(stock(spark, sf_dir), F.col("pb_ratio") > 0.05, high()).select("asset", "date", "count_since")

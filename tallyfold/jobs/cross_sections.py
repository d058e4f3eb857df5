"""Queries on cross-sections, positions and factors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.jobs.panels import PORTFOLIO, STOCK, cells, fund_dates, portfolio, risk_free, stock, table, wa
from tallyfold.jobs.registry import query, r, rs
from tallyfold.operators import factors as f
from tallyfold.operators import performance as p
from tallyfold.operators import windows as w
from tallyfold.operators import xsec as x
from tallyfold.operators.panel import align_force


_PCT = "CASE WHEN close IS NOT NULL THEN (row_number() OVER up - 1) / CAST(nullif(count(close) OVER wd - 1, 0) AS DOUBLE) END"

_OLDER = "CASE WHEN close IS NOT NULL THEN (row_number() OVER up - 1) / CAST(count(close) OVER wd AS DOUBLE) END"
_TOP = "coalesce(roe > 0.04, false) AND row_number() OVER (PARTITION BY date, coalesce(roe > 0.04, false) ORDER BY close ASC NULLS LAST, asset) <= 5"


def _add(name: str, column: str, made: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query of the stock panel with a column that needs the order of a date's assets."""
    text = f"WITH {STOCK} SELECT asset, date, {sql} AS {column} FROM stock WINDOW wd AS (PARTITION BY date), up AS (PARTITION BY date ORDER BY close ASC NULLS LAST, asset)"
    query(name, text)(lambda spark, sf_dir: made(stock(spark, sf_dir)).select("asset", "date", column))


_add("X1_pct", "pct", lambda d: x.with_pct(d, F.col("close"), "_p").withColumn("pct", r("_p")), rs(_PCT))
_add("X2_pct_older", "pct", lambda d: x.with_pct(d, F.col("close"), "_p", older=True).withColumn("pct", r("_p")), rs(_OLDER))
_add("X3_rank", "place", lambda d: x.with_rank(d, F.col("close")), "row_number() OVER up - 1")
_add("X4_top_n", "top", lambda d: x.with_top_n(d, F.col("close"), F.col("roe") > 0.04, 5), _TOP)


def _add_frame(name: str, column: str, made: Callable[[DataFrame], DataFrame], sql: str, digits: int = 6) -> None:
    """A query of the stock panel with a column that needs sums over a date."""
    text = f"WITH {STOCK} SELECT asset, date, {rs(sql, digits)} AS {column} FROM stock WINDOW wd AS (PARTITION BY date)"
    query(name, text)(lambda spark, sf_dir: made(stock(spark, sf_dir)).select("asset", "date", r(column, digits).alias(column)))


_add_frame("X6_scale_row", "scaled", lambda d: x.scale_row(d, F.col("close")), "(close - min(close) OVER wd) / nullif(max(close) OVER wd - min(close) OVER wd, 0)")
_add_frame("X12_equal_weights", "weight", lambda d: x.equal_weights(d, F.col("close")), "CASE WHEN close IS NOT NULL THEN 1.0 / count(close) OVER wd ELSE 0.0 END")
_ALPHA = "round(pb_ratio - 0.05, 8)"
_add_frame(
    "X13_add_alpha",
    "weight",
    lambda d: x.add_alpha(d, F.lit(0.01), F.round(F.col("pb_ratio") - 0.05, 8)),
    f"0.01 + (-max(CASE WHEN {_ALPHA} < 0 THEN 0.01 / {_ALPHA} END) OVER wd) * {_ALPHA}",
    5,
)
_add_frame("X15_residual_one", "residual", lambda d: x.residual_one(d, F.col("close"), F.col("roe")), "close - sum(roe * close) OVER wd / sum(roe * roe) OVER wd * roe", 4)
_s = lambda a, b: f"sum({a} * {b}) OVER wd"
_DET = f"({_s('roe', 'roe')} * {_s('pb_ratio', 'pb_ratio')} - {_s('roe', 'pb_ratio')} * {_s('roe', 'pb_ratio')})"
_add_frame(
    "X15_residual_two",
    "residual",
    lambda d: x.residual_two(d, F.col("close"), F.col("roe"), F.col("pb_ratio")),
    f"close - ({_s('roe', 'close')} * {_s('pb_ratio', 'pb_ratio')} - {_s('pb_ratio', 'close')} * {_s('roe', 'pb_ratio')}) / {_DET} * roe"
    f" - ({_s('pb_ratio', 'close')} * {_s('roe', 'roe')} - {_s('roe', 'close')} * {_s('roe', 'pb_ratio')}) / {_DET} * pb_ratio",
    3,
)


def orthogonal(source: str, by: str, columns: list[str], y: str = "y", prefix: str = "o") -> tuple[list[str], str]:
    """CTEs that make columns orthogonal one after the other within a group, and y's projection on them, for rows that have all.

    Each step takes the parts along the columns before out of a column by sums over the group.
    """
    dot = lambda a, b: f"sum({a} * {b}) OVER g"
    ctes, names = [f"{prefix}0 AS (SELECT *, {columns[0]} AS u0 FROM {source})"], ["u0"]
    for k, c in enumerate(columns[1:], 1):
        away = " - ".join([c, *[f"coalesce({dot(c, u)} / nullif({dot(u, u)}, 0), 0) * {u}" for u in names]])
        ctes += [f"{prefix}{k} AS (SELECT *, {away} AS u{k} FROM {prefix}{k - 1} WINDOW g AS (PARTITION BY {by}))"]
        names.append(f"u{k}")
    return ctes, " + ".join(f"coalesce({dot(y, u)} / nullif({dot(u, u)}, 0), 0) * {u}" for u in names)


_COMPLETE = "close IS NOT NULL AND roe IS NOT NULL AND pb_ratio IS NOT NULL AND asset_growth IS NOT NULL"
_ctes, _projected = orthogonal("whole", "date", ["pb_ratio", "asset_growth", "roe"], "close")
_WHOLE = f"WITH {STOCK}, whole AS (SELECT * FROM stock WHERE {_COMPLETE}), {', '.join(_ctes)}"


@query(
    "X15_residual_many",
    f"{_WHOLE}, res AS (SELECT asset, date, close - ({_projected}) AS residual FROM o2 WINDOW g AS (PARTITION BY date)) SELECT asset, date, {rs('residual', 3)} AS residual FROM stock LEFT JOIN res USING (asset, date)",
)
def _(spark, sf_dir):
    return x.residual_many(stock(spark, sf_dir), "close", ["roe", "pb_ratio", "asset_growth"]).select("asset", "date", r("residual", 3).alias("residual"))


@query("X5_largest", f"WITH {STOCK} SELECT asset, date, close FROM stock WHERE close IS NOT NULL ORDER BY close DESC, asset, date LIMIT 10")
def _(spark, sf_dir):
    return x.largest(stock(spark, sf_dir), "close", 10).select("asset", "date", "close")


@query("X7_scale_all", f"WITH {STOCK} SELECT asset, date, {rs('(close - lo) / nullif(hi - lo, 0)')} AS scaled FROM stock CROSS JOIN (SELECT min(close) AS lo, max(close) AS hi FROM stock)")
def _(spark, sf_dir):
    return x.scale_all(stock(spark, sf_dir), "close").select("asset", "date", r("scaled").alias("scaled"))


MEASURES = ("pb_ratio", "roe", "asset_growth")


def _cuts_cte(panel: str) -> str:
    per = ", ".join(f"round(quantile_cont({m}, 0.3), 12) AS {m}_lo, round(quantile_cont({m}, 0.7), 12) AS {m}_hi" for m in MEASURES)
    cut = ", ".join(f"CAST(CASE WHEN {m} IS NULL THEN NULL WHEN {m} <= {m}_lo THEN -1 WHEN {m} >= {m}_hi THEN 1 ELSE 0 END AS BIGINT) AS {m}_cut" for m in MEASURES)
    return (
        f"limits AS (SELECT date, round(median(market_cap), 12) AS size_mid, {per} FROM {panel} GROUP BY 1), cut AS (SELECT {panel}.*, "
        f"CAST(CASE WHEN market_cap >= size_mid THEN 1 WHEN market_cap < size_mid THEN -1 END AS BIGINT) AS size_cut, {cut} FROM {panel} JOIN limits USING (date))"
    )


@query("X8_size_cut", f"WITH {STOCK}, {_cuts_cte('stock')} SELECT asset, date, size_cut FROM cut")
def _(spark, sf_dir):
    return x.cuts(stock(spark, sf_dir)).select("asset", "date", "size_cut")


@query("X9_three_way_cuts", f"WITH {STOCK}, {_cuts_cte('stock')} SELECT asset, date, pb_ratio_cut, roe_cut, asset_growth_cut FROM cut")
def _(spark, sf_dir):
    return x.cuts(stock(spark, sf_dir)).select("asset", "date", "pb_ratio_cut", "roe_cut", "asset_growth_cut")


@query(
    "X10_rank_select",
    f"WITH {STOCK}, m AS (SELECT asset, date, CASE WHEN coalesce(roe > 0.035, false) THEN close END AS v FROM stock) "
    "SELECT asset, date, coalesce(CASE WHEN v IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY v ASC NULLS LAST, asset) - 1) / CAST(nullif(count(v) OVER (PARTITION BY date) - 1, 0) AS DOUBLE) END BETWEEN 0.8 AND 1.0, false) AS chosen FROM m",
)
def _(spark, sf_dir):
    return x.between_pct(stock(spark, sf_dir), F.col("close"), F.col("roe") > 0.035, 0.8, 1.0).select("asset", "date", "chosen")


def _with_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").cast("long").alias("grp"))
    return stock(spark, sf_dir).join(nation, "asset", "left")


_GROUPED = f"{STOCK}, g AS (SELECT stock.*, CAST(s_nationkey AS BIGINT) AS grp FROM stock LEFT JOIN supplier ON s_suppkey = asset)"


@query(
    "X10_rank_select_regions",
    f"WITH {_GROUPED} SELECT asset, date, coalesce(CASE WHEN close IS NOT NULL AND grp IS NOT NULL THEN (row_number() OVER (PARTITION BY date, grp ORDER BY close ASC NULLS LAST, asset) - 1) / CAST(nullif(count(close) OVER (PARTITION BY date, grp) - 1, 0) AS DOUBLE) END BETWEEN 0.5 AND 1.0, false) AS chosen FROM g",
)
def _(spark, sf_dir):
    return x.select_in_regions(_with_group(spark, sf_dir), "close", "grp", 0.5, 1.0).select("asset", "date", "chosen")


_REGIONS = {"roe > 0.035": lambda: F.col("roe") > 0.035, "pb_ratio > 0.045": lambda: F.col("pb_ratio") > 0.045, "asset % 3 = 0": lambda: F.col("asset") % 3 == 0}
_FLAGS = " UNION ALL ".join(
    f"SELECT asset, date FROM (SELECT asset, date, (row_number() OVER (PARTITION BY date ORDER BY close, asset) - 1) / CAST(nullif(count(*) OVER (PARTITION BY date) - 1, 0) AS DOUBLE) AS pct FROM stock WHERE close IS NOT NULL AND asset_growth < 0.5 AND {s}) WHERE pct BETWEEN 0.5 AND 1.0"
    for s in _REGIONS
)


@query("X10_rank_select_list", f"WITH {STOCK}, flags AS (SELECT asset, date, CAST(count(*) AS DOUBLE) AS n FROM ({_FLAGS}) GROUP BY 1, 2) SELECT asset, date, coalesce(n, 0.0) AS chosen FROM stock LEFT JOIN flags USING (asset, date)")
def _(spark, sf_dir):
    regions = [made() for made in _REGIONS.values()]
    return x.rank_select(stock(spark, sf_dir), F.col("close"), regions, 0.5, 1.0, F.col("asset_growth") < 0.5).select("asset", "date", "chosen")


_POSITIONS = (
    f"WITH {STOCK}, ranked AS (SELECT *, CASE WHEN close IS NOT NULL THEN (row_number() OVER (PARTITION BY date ORDER BY close ASC NULLS LAST, asset) - 1) / CAST(nullif(count(close) OVER (PARTITION BY date) - 1, 0) AS DOUBLE) END AS pct "
    "FROM (SELECT asset, date, i, close AS price, CASE WHEN coalesce(roe < 0.02, false) THEN NULL ELSE close END AS close, coalesce(roe < 0.02, false) AS excluded FROM stock)), "
    "raw AS (SELECT *, CASE WHEN pct BETWEEN 0.8 AND 1.0 THEN 1.0 ELSE 0.0 END - CASE WHEN pct BETWEEN 1 - 1.0 AND 1 - 0.8 THEN 1.0 ELSE 0.0 END AS raw FROM ranked), "
    "pos AS (SELECT *, CASE WHEN excluded THEN 0.0 ELSE (last_value(CASE WHEN i % 3 = 0 THEN {'v': raw} END IGNORE NULLS) OVER (PARTITION BY asset ORDER BY i ROWS UNBOUNDED PRECEDING)).v END AS pos FROM raw)"
)


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.positions(stock(spark, sf_dir), "close", F.col("roe") < 0.02, 0.8, 1.0, 3, True)


@query("X11_positions", f"{_POSITIONS} SELECT asset, date, CAST(pos AS DOUBLE) AS pos FROM pos")
def _(spark, sf_dir):
    return _positions(spark, sf_dir).select("asset", "date", "pos")


@query("X14_group_means", f"WITH {_GROUPED} SELECT date, grp, {rs('m')} AS mean FROM (SELECT DISTINCT date FROM g) CROSS JOIN (SELECT DISTINCT grp FROM g WHERE grp != 0) LEFT JOIN (SELECT date, grp, avg(close) AS m FROM g WHERE grp != 0 GROUP BY 1, 2) USING (date, grp)")
def _(spark, sf_dir):
    return x.group_means(_with_group(spark, sf_dir), "close", "grp").select("date", "grp", r("mean").alias("mean"))


@query("X16_first_coefficient", f"WITH {STOCK} SELECT date, {rs('sum(roe * close) / nullif(sum(CASE WHEN close IS NOT NULL THEN roe * roe END), 0)', 4)} AS beta FROM stock GROUP BY 1")
def _(spark, sf_dir):
    return x.first_coefficient(stock(spark, sf_dir), "close", "roe").select("date", r("beta", 4).alias("beta"))


@query("X16_first_coefficient_many", f"{_WHOLE} SELECT date, {rs('max(beta)', 3)} AS beta FROM (SELECT DISTINCT date FROM stock) LEFT JOIN (SELECT date, sum(u2 * close) / nullif(sum(u2 * u2), 0) AS beta FROM o2 GROUP BY 1) USING (date) GROUP BY 1")
def _(spark, sf_dir):
    return x.first_coefficient(stock(spark, sf_dir), "close", ["roe", "pb_ratio", "asset_growth"]).select("date", r("beta", 3).alias("beta"))


@query(
    "X17_first_extreme",
    f"WITH {STOCK} SELECT asset, a.i AS hi_at, b.i AS lo_at FROM (SELECT asset, i, row_number() OVER (PARTITION BY asset ORDER BY qty DESC, i) AS n FROM stock WHERE qty IS NOT NULL) a JOIN (SELECT asset, i, row_number() OVER (PARTITION BY asset ORDER BY qty, i) AS n FROM stock WHERE qty IS NOT NULL) b USING (asset) WHERE a.n = 1 AND b.n = 1",
)
def _(spark, sf_dir):
    d = stock(spark, sf_dir)
    hi, lo = x.first_extreme(d, "qty", "i", "asset"), x.first_extreme(d, "qty", "i", "asset", largest=False)
    return hi.withColumnRenamed("place", "hi_at").join(lo.withColumnRenamed("place", "lo_at"), "asset")


# factors: the panel is forced onto the fund's calendar first


def aligned(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The stock panel on the fund's months (or weeks), filled forward, with returns and growth: the input of the factors."""
    d = align_force(cells(spark, sf_dir, unit), fund_dates(spark, sf_dir, unit), ["close", "market_cap", "pb_ratio", "roe", "qty"])
    return d.select("asset", "date", "i", r(w.reldiff(F.col("close"), wa()), 10).alias("ret"), "market_cap", "pb_ratio", "roe", r(w.reldiff(F.col("qty"), wa()), 10).alias("asset_growth"))


_fill = lambda c: f"last_value({c} IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pcal.i ROWS UNBOUNDED PRECEDING) AS {c}"
ALIGNED = (
    f"{STOCK}, {PORTFOLIO}, filled AS (SELECT asset, pcal.date, pcal.i, {', '.join(_fill(c) for c in ('close', 'market_cap', 'pb_ratio', 'roe', 'qty'))} "
    "FROM pcal CROSS JOIN (SELECT DISTINCT asset FROM cells) a LEFT JOIN cells USING (asset, date)), "
    f"aligned AS (SELECT asset, date, i, {rs('coalesce(close / lag(close) OVER (PARTITION BY asset ORDER BY i) - 1, 0)', 10)} AS ret, market_cap, pb_ratio, roe, "
    f"{rs('coalesce(qty / lag(qty) OVER (PARTITION BY asset ORDER BY i) - 1, 0)', 10)} AS asset_growth FROM filled), {_cuts_cte('aligned')}"
)


def _bucket(side: str, letter: str) -> str:
    for m, letters in f.LETTERS.items():
        if letter in letters:
            chosen = f"{m}_cut = {(1, 0, -1)[letters.index(letter)]} AND size_cut = {1 if side == 'B' else -1}"
            return f"coalesce(sum(CASE WHEN {chosen} THEN ret * market_cap END) / nullif(sum(CASE WHEN {chosen} THEN market_cap END), 0), 0) AS {side}{letter}"
    raise KeyError(letter)


_NAMES = [(s, letter) for letters in f.LETTERS.values() for letter in letters for s in "BS"]
BUCKETS = f"{ALIGNED}, buckets AS (SELECT date, coalesce(sum(ret * market_cap) / nullif(sum(market_cap), 0), 0) AS rm, {', '.join(_bucket(*n) for n in _NAMES)} FROM cut GROUP BY 1)"
_size = lambda a, b: f"(S{a} + (SN_roe + SN_growth) / 2 + S{b}) / 3 - (B{a} + (BN_roe + BN_growth) / 2 + B{b}) / 3"
_spread = lambda a, b: f"(S{a} + B{a}) / 2 - (S{b} + B{b}) / 2"
FACTORS = f"{BUCKETS}, factors AS (SELECT date, rm, ({_size('H', 'L')} + {_size('R', 'W')} + {_size('C', 'A')}) / 3 AS smb, {_spread('H', 'L')} AS hml, {_spread('R', 'W')} AS rmw, {_spread('C', 'A')} AS cma FROM buckets)"


def factor_rows(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    return f.five_factors(f.buckets(x.cuts(aligned(spark, sf_dir, unit))))


@query("A1_market_return", f"WITH {BUCKETS} SELECT date, {rs('rm', 8)} AS rm FROM buckets")
def _(spark, sf_dir):
    return f.market_return(aligned(spark, sf_dir)).select("date", r("rm", 8).alias("rm"))


@query("A2_buckets", f"WITH {BUCKETS} SELECT date, {', '.join(rs(s + n, 8) + ' AS ' + s + n for s, n in _NAMES)} FROM buckets")
def _(spark, sf_dir):
    return f.buckets(x.cuts(aligned(spark, sf_dir))).select("date", *[r(s + n, 8).alias(s + n) for s, n in _NAMES])


_FIVE = ("rm", "smb", "hml", "rmw", "cma")


@query("A3_five_factors", f"WITH {FACTORS} SELECT date, {', '.join(rs(c, 8) + ' AS ' + c for c in _FIVE)} FROM factors")
def five_factors(spark, sf_dir):
    return factor_rows(spark, sf_dir).select("date", *[r(c, 8).alias(c) for c in _FIVE])


_FLAG = "CASE WHEN (asset + i) % 7 = 0 THEN 1 WHEN (asset + i) % 7 = 1 THEN -1 ELSE 0 END"


@query(
    "A4_event_factor",
    f"WITH {STOCK}, e AS (SELECT date, avg(CASE WHEN flag = 1 THEN ret END) - avg(CASE WHEN flag = -1 THEN ret END) AS d FROM (SELECT date, {_FLAG} AS flag, coalesce(close / lag(close) OVER (PARTITION BY asset ORDER BY i) - 1, 0) AS ret FROM stock) GROUP BY 1) "
    f"SELECT row_number() OVER (ORDER BY date) AS step, date, {rs('product(1 + coalesce(d, 0)) OVER (ORDER BY date)')} AS value FROM e UNION ALL SELECT 0, NULL, 1.0",
)
def _(spark, sf_dir):
    d = stock(spark, sf_dir).select("date", F.expr(_FLAG).alias("flag"), w.reldiff(F.col("close"), wa()).alias("ret"))
    return f.event_factor(d).select("step", "date", r("value").alias("value"))


@query("A5_period_counts", f"WITH {PORTFOLIO} SELECT year(date) AS year, quarter(date) AS quarter, count(*) AS n FROM pcal GROUP BY 1, 2")
def _(spark, sf_dir):
    return f.period_counts(fund_dates(spark, sf_dir))


@query("A5_period_counts_monthly", f"WITH {PORTFOLIO} SELECT year(date) AS year, month(date) AS month, count(*) AS n FROM pcal GROUP BY 1, 2")
def _(spark, sf_dir):
    return f.period_counts(fund_dates(spark, sf_dir), monthly=True)


def attribution_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By week, so that a quarter has more rows than there are coefficients."""
    p_ = portfolio(spark, sf_dir, "week")
    ret = p_.select("deal", "date", r(w.reldiff(F.col("close"), w.by_asset("deal")), 10).alias("ret"))
    return f.attribution(ret, factor_rows(spark, sf_dir, "week"), risk_free(spark, sf_dir, "week"))


@query("A6_attribution")
def _(spark, sf_dir):
    return attribution_rows(spark, sf_dir)


def _beta_sql(k: int) -> tuple[str, str]:
    """CTEs and a query of one coefficient: least squares of y on what of its column the others don't explain."""
    ctes, _ = orthogonal("lines", "deal, yy, qq", [t for t in _TERMS if t != _TERMS[k]] + [_TERMS[k]], prefix=f"b{k}_")
    beta = f"SELECT deal, last_day(min(date)) AS period, '{'const' if k == 0 else _TERMS[k]}' AS term, {rs('sum(u5 * y) / sum(u5 * u5)', 4)} AS beta FROM b{k}_5 GROUP BY deal, yy, qq HAVING count(*) > 6"
    return ", ".join(ctes), beta


def _t_sql(k: int) -> str:
    """A query of one t-value: what the columns leave of y, over the rows to spare, gives the error of what its own column has left."""
    term = "const" if k == 0 else _TERMS[k]
    rest = "sum(y * y) - " + " - ".join(f"coalesce(sum(u{j} * y) * sum(u{j} * y) / nullif(sum(u{j} * u{j}), 0), 0)" for j in range(6))
    return f"SELECT deal, last_day(min(date)) AS period, '{term}' AS term, {rs(f'sum(u5 * y) / sqrt(sum(u5 * u5)) / sqrt(({rest}) / (count(*) - 6))', 2)} AS t_value FROM b{k}_5 GROUP BY deal, yy, qq HAVING count(*) > 6"


_TERMS = ("one", *f.TERMS[1:])
_CHAINS = [_beta_sql(k) for k in range(len(_TERMS))]
_A6 = (
    f"WITH {FACTORS}, rf AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, {rs('avg(l_discount) / 1000', 8)} AS rf FROM lineitem GROUP BY 1), "
    f"fund AS (SELECT deal, date, {rs('coalesce(close / lag(close) OVER (PARTITION BY deal ORDER BY i) - 1, 0)', 10)} AS y FROM portfolio), "
    "lines AS (SELECT deal, date, year(date) AS yy, quarter(date) AS qq, y, 1.0 AS one, rm - coalesce(rf, 0) AS rm_rf, smb, hml, rmw, cma FROM fund JOIN factors USING (date) LEFT JOIN rf USING (date)), "
    f"{', '.join(c for c, _ in _CHAINS)} "
).replace("'month'", "'week'")
_BETAS, _T_VALUES = _A6 + " UNION ALL ".join(b for _, b in _CHAINS), _A6 + " UNION ALL ".join(_t_sql(k) for k in range(len(_TERMS)))


@query("A6_betas", _BETAS)
def _(spark, sf_dir):
    """The coefficients of quarters with rows to spare."""
    return attribution_rows(spark, sf_dir).filter("p_value is not null").select("deal", "period", "term", r("beta", 4).alias("beta"))


@query("A6_t_values", _T_VALUES)
def _(spark, sf_dir):
    """What the p-values follow from, in the same quarters."""
    return attribution_rows(spark, sf_dir).filter("p_value is not null").select("deal", "period", "term", r("t_value", 2).alias("t_value"))


@query("A7_factor_means", f"WITH {FACTORS} SELECT last_day(min(date)) AS period, {', '.join(rs('avg(' + c + ')', 8) + ' AS ' + c for c in _FIVE[1:])} FROM factors GROUP BY year(date), quarter(date)")
def factor_mean_rows(spark, sf_dir):
    return f.factor_means(factor_rows(spark, sf_dir)).select("period", *[r(c, 8).alias(c) for c in _FIVE[1:]])


_NAV = (
    f"{_POSITIONS}, parts AS (SELECT date, coalesce(price / lag(price) OVER (PARTITION BY asset ORDER BY i) - 1, 0) * lag(pos) OVER (PARTITION BY asset ORDER BY i) / 100 AS r FROM pos), "
    "total AS (SELECT date, coalesce(sum(r), 0) AS r FROM parts GROUP BY 1)"
)


@query("A8_portfolio_nav", f"{_NAV} SELECT date, {rs('product(1 + r) OVER (ORDER BY date)')} AS nav FROM total")
def _(spark, sf_dir):
    d = _positions(spark, sf_dir).withColumn("pos", F.col("pos") / 100)
    return f.portfolio_nav(d, wa()).select("date", r("nav").alias("nav"))


@query("A9_tabulate", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    return f.tabulate(table(spark, sf_dir, "events"), "event_type")


@query("A10_first_seen", "SELECT event_type, min(event_id) AS first_at FROM events GROUP BY 1")
def _(spark, sf_dir):
    return f.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id")


@query("A11_duplicate_dates", "SELECT l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("series_id"), F.col("l_shipdate").cast("date").alias("date"))
    return f.duplicate_dates(d, ["series_id", "date"])


_SEG = "CAST(greatest(least(coalesce(ceil((l_quantity - a) / nullif(width, 0)) - 1, 0), 4), 0) AS BIGINT)"
_SEGMENTS = f"WITH e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, (max(l_quantity) - min(l_quantity)) / 5 AS width FROM lineitem), fitted AS (SELECT {_SEG} AS segment, avg(l_extendedprice) AS mean FROM lineitem CROSS JOIN e GROUP BY 1)"


@query("A12_segment_fit", f"{_SEGMENTS} SELECT segment, {rs('a + segment * width')} AS lo, {rs('a + (segment + 1) * width')} AS hi, {rs('mean', 3)} AS mean FROM fitted CROSS JOIN e")
def _(spark, sf_dir):
    d = f.segment_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return d.select("segment", r("lo").alias("lo"), r("hi").alias("hi"), r("mean", 3).alias("mean"))


@query("A12_segment_predict", f"{_SEGMENTS} SELECT l_orderkey, l_linenumber, {rs('mean', 3)} AS predicted FROM (SELECT l_orderkey, l_linenumber, {_SEG} AS segment FROM lineitem CROSS JOIN e) JOIN fitted USING (segment)")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    fitted = f.segment_fit(li, "l_quantity", "l_extendedprice")
    return f.segment_predict(li, fitted, "l_quantity").select("l_orderkey", "l_linenumber", r("predicted", 3).alias("predicted"))


@query("A13_poly_fit")
def _(spark, sf_dir):
    return f.poly_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


_ctes, _projected = orthogonal("poly", "l_returnflag", ["one", "z", "z * z", "z * z * z"])
_POLY = (
    "poly AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS y, 1.0 AS one, (l_quantity - m) / s AS z FROM lineitem JOIN (SELECT l_returnflag, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY 1) USING (l_returnflag)), "
    + ", ".join(_ctes)
)


@query("A13_poly_predict", f"WITH {_POLY} SELECT l_orderkey, l_linenumber, {rs(_projected, 3)} AS predicted FROM o3 WINDOW g AS (PARTITION BY l_returnflag)")
def _(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_extendedprice")
    return f.poly_predict(li, f.poly_fit(li, "l_quantity", "l_extendedprice", "l_returnflag"), "l_quantity", "l_returnflag").select("l_orderkey", "l_linenumber", r("predicted", 3).alias("predicted"))


@query(
    "A15_integer_shares",
    "WITH n AS (SELECT n_regionkey AS region, n_nationkey AS nation, count(c_custkey) AS c FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2), "
    "wt AS (SELECT region, nation, round(c / CAST(sum(c) OVER (PARTITION BY region) AS DOUBLE), 6) AS weight FROM n), "
    "raw AS (SELECT *, CAST(round_even(23 * weight, 0) AS BIGINT) AS raw FROM wt), "
    "gap AS (SELECT *, 23 - sum(raw) OVER (PARTITION BY region) AS gap, coalesce(sum(raw) OVER (PARTITION BY region ORDER BY weight, nation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, "
    "row_number() OVER (PARTITION BY region ORDER BY weight DESC, nation) AS top FROM raw) "
    "SELECT CAST(region AS BIGINT) AS region, CAST(nation AS BIGINT) AS nation, CAST(CASE WHEN gap > 0 THEN raw + CASE WHEN top = 1 THEN gap ELSE 0 END ELSE raw - greatest(0, least(raw, -gap - before)) END AS BIGINT) AS share FROM gap",
)
def _(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    n = nation.join(customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_regionkey").cast("long").alias("region"), F.col("n_nationkey").cast("long").alias("nation")).agg(F.count("c_custkey").alias("c"))
    total = n.groupBy("region").agg(F.sum("c").alias("t"))
    d = n.join(total, "region").select("region", "nation", F.round(F.col("c") / F.col("t"), 6).alias("weight"))
    return f.integer_shares(d, "weight", "nation", "region", F.lit(23).cast("long")).select("region", "nation", "share")


# performance of the funds


def _funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio(spark, sf_dir).filter(F.col("close").isNotNull()).select(F.col("deal").alias("series_id"), "date", F.col("close").alias("nav"))


_PERF = (
    f"WITH {PORTFOLIO}, v AS (SELECT deal AS series_id, date, close AS nav, row_number() OVER (PARTITION BY deal ORDER BY date) - 1 AS n, max(close) OVER (PARTITION BY deal ORDER BY date) AS peak, "
    "close / lag(close) OVER (PARTITION BY deal ORDER BY date) - 1 AS ret FROM deals), "
    "run AS (SELECT *, sum(CAST(nav >= peak AS INT)) OVER (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM v), "
    "dd AS (SELECT *, peak / nav - 1 AS drawdown, row_number() OVER (PARTITION BY series_id, run ORDER BY date) - 1 AS below FROM run), "
    "base AS (SELECT series_id, min(date) AS s, max(date) AS e, count(*) AS n, avg(ret) AS m, stddev_pop(ret) AS sd, max(drawdown) AS max_dd, max(below) AS longest_below, "
    "sum(CAST(ret >= 0 AS INT)) AS won, count(ret) AS rets FROM dd GROUP BY 1), "
    "out AS (SELECT *, n / ((e - s) / 365.25) AS f FROM base) "
)


@query("M1_max_drawdown", f"{_PERF} SELECT series_id, {rs('max_dd')} AS max_dd FROM out")
def _(spark, sf_dir):
    return p.max_drawdown(_funds(spark, sf_dir)).select("series_id", r("max_dd").alias("max_dd"))


@query("M2_longest_below", f"{_PERF} SELECT series_id, {rs('max_dd')} AS max_dd, longest_below FROM out")
def _(spark, sf_dir):
    return p.max_drawdown(_funds(spark, sf_dir)).select("series_id", r("max_dd").alias("max_dd"), "longest_below")


@query("M3_annual_factor", f"{_PERF} SELECT series_id, {rs('f')} AS ann_fac FROM out")
def _(spark, sf_dir):
    return p.metrics(_funds(spark, sf_dir)).select("series_id", r("ann_fac").alias("ann_fac"))


@query("M4_return_and_risk", f"{_PERF} SELECT series_id, {rs('m * f')} AS ann_ret, {rs('sd * sqrt(f)')} AS ann_vol, {rs('m * f / (sd * sqrt(f))')} AS sharpe, {rs('m * f / max_dd')} AS ret_dd FROM out")
def _(spark, sf_dir):
    return p.metrics(_funds(spark, sf_dir)).select("series_id", *[r(c).alias(c) for c in ("ann_ret", "ann_vol", "sharpe", "ret_dd")])


@query("M5_win_rate", f"{_PERF} SELECT series_id, {rs('won / CAST(rets + 1 AS DOUBLE)')} AS win_rate FROM out")
def _(spark, sf_dir):
    return p.metrics(_funds(spark, sf_dir)).select("series_id", r("win_rate").alias("win_rate"))


@query("M6_range", f'{_PERF} SELECT series_id, s AS start, e AS "end", CAST(e - s AS BIGINT) AS days, n + 1 AS n_data FROM out')
def _(spark, sf_dir):
    return p.metrics(_funds(spark, sf_dir)).select("series_id", "start", "end", "days", "n_data")


@query("M6_range_without_dates", f"{_PERF} SELECT series_id, CAST(NULL AS DATE) AS start, 250.0 AS ann_fac, {rs('m * 250')} AS ann_ret, n AS n_data FROM out")
def _(spark, sf_dir):
    return p.metrics(_funds(spark, sf_dir), dated=False).select("series_id", "start", "ann_fac", r("ann_ret").alias("ann_ret"), "n_data")


@query(
    "M7_all_metrics",
    f'{_PERF} SELECT series_id, {rs("f")} AS ann_fac, {rs("m * f")} AS ann_ret, {rs("sd * sqrt(f)")} AS ann_vol, {rs("m * f / (sd * sqrt(f))")} AS sharpe, {rs("max_dd")} AS max_dd, longest_below, '
    f'{rs("m * f / max_dd")} AS ret_dd, {rs("won / CAST(rets + 1 AS DOUBLE)")} AS win_rate, s AS start, e AS "end", CAST(e - s AS BIGINT) AS days, n + 1 AS n_data FROM out',
)
def _(spark, sf_dir):
    d = p.metrics(_funds(spark, sf_dir))
    rounded = {"ann_fac", "ann_ret", "ann_vol", "sharpe", "max_dd", "ret_dd", "win_rate"}
    return d.select(*[r(c).alias(c) if c in rounded else F.col(c) for c in d.columns])

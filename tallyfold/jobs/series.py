"""Queries on alignment, merging, cleaning, correlation, dates, text, graphs and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.functions import dates as dt
from tallyfold.functions import text as tx
from tallyfold.functions.cells import is_numeric
from tallyfold.jobs import cross_sections as cs
from tallyfold.jobs.panels import EVENTS, NEW_OLD, PORTFOLIO, SERIES, STOCK, cells, event_cells, events_dense, fund_dates, new_and_old, portfolio, series, stock, table
from tallyfold.jobs.registry import ORACLES, query, r, rs
from tallyfold.operators import align as al
from tallyfold.operators import cluster as cl
from tallyfold.operators import graph as gr
from tallyfold.operators import panel as pn
from tallyfold.operators import windows as w
from tallyfold.operators.factors import TERMS
from tallyfold.sources import files as io
from tallyfold.sources.storage import cut, scratch
from tallyfold.streaming.ingest import ingest, stored

# alignment

_DATES = "SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders"


@query("J1_align_keep", f"WITH {STOCK}, d AS ({_DATES}), e AS (SELECT CAST(ts AS DATE) AS date, count(*) AS n FROM events GROUP BY 1) SELECT coalesce(e.date, d.date) AS date, n, n IS NULL AS added FROM e FULL JOIN d ON e.date = d.date")
def _(spark, sf_dir):
    daily = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return pn.align_keep(daily, portfolio(spark, sf_dir).select("date")).select("date", "n", "added")


@query("J2_align_force", f"WITH {STOCK}, {PORTFOLIO} SELECT asset, pcal.date, last_value(close IGNORE NULLS) OVER (PARTITION BY asset ORDER BY pcal.i ROWS UNBOUNDED PRECEDING) AS close FROM pcal CROSS JOIN (SELECT DISTINCT asset FROM cells) a LEFT JOIN cells USING (asset, date)")
def _(spark, sf_dir):
    return pn.align_force(cells(spark, sf_dir), fund_dates(spark, sf_dir), ["close"]).select("asset", "date", "close")


_MERGED = (
    f"WITH {NEW_OLD}, m AS (SELECT coalesce(n.series_id, o.series_id) AS series_id, coalesce(n.time, o.time) AS time, coalesce(n.value, o.value) AS value, "
    "CASE WHEN o.series_id IS NULL THEN 'new' WHEN n.series_id IS NULL THEN 'old' ELSE 'both' END AS side, coalesce(CASE WHEN o.value = 0 THEN n.value > 0 ELSE n.value / o.value - 1 > 1e-8 END, false) AS flagged "
    "FROM newer n FULL JOIN older o ON n.series_id = o.series_id AND n.time = o.time)"
)


@query("J3_merge", f"{_MERGED} SELECT * FROM m")
def _(spark, sf_dir):
    return al.merge(*new_and_old(spark, sf_dir))


@query("J3_merge_summary", f"{_MERGED} SELECT series_id, CAST(sum(CAST(side = 'new' AS INT)) AS BIGINT) AS only_new, CAST(sum(CAST(side = 'old' AS INT)) AS BIGINT) AS only_old, CAST(sum(CAST(side = 'both' AS INT)) AS BIGINT) AS both, CAST(sum(CAST(flagged AS INT)) AS BIGINT) AS flagged FROM m GROUP BY 1")
def _(spark, sf_dir):
    return al.merge_summary(al.merge(*new_and_old(spark, sf_dir)))


@query("J4_merge_into", f"{_MERGED} SELECT series_id, time, value FROM m")
def _(spark, sf_dir):
    return al.merge_into(*new_and_old(spark, sf_dir))


@query("J4_stream_ingest", f"SELECT event_type AS series_id, CAST(ts AS DATE) AS time, {rs('avg(value)')} AS value FROM events GROUP BY 1, 2")
def _(spark, sf_dir):
    kept = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(kept).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    store = scratch(spark, "store")
    ingest(stream, F.col("event_type"), F.col("ts").cast("date"), F.col("value"), store, scratch(spark, "progress")).awaitTermination()
    return stored(spark, store).select("series_id", "time", r("value").alias("value"))


@query("J5_union_times", f"WITH {SERIES} SELECT DISTINCT time FROM series")
def _(spark, sf_dir):
    return al.union_times(series(spark, sf_dir))


@query("J6_regular_dates", "WITH b AS (SELECT user_id AS asset, min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events GROUP BY 1) SELECT asset, lo + CAST(k * 5 AS INT) AS date FROM b CROSS JOIN range(0, 400) t(k) WHERE k <= ceil((hi - lo) / 5.0)")
def _(spark, sf_dir):
    e = event_cells(spark, sf_dir).groupBy("asset").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return e.select("asset", F.explode(pn.regular_dates(F.col("lo"), F.col("hi"), 5)).alias("date"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given target hours: every seventh from the first observation to a day after the last."""
    ends = series(spark, sf_dir).agg(F.min("time").alias("a"), F.max("time").alias("b"))
    return ends.select(F.explode(F.sequence("a", F.col("b") + 24, F.lit(7).cast("long"))).alias("time"))


_T = f"{SERIES}, targets AS (SELECT unnest(range(a, b + 25, 7)) AS time FROM (SELECT min(time) AS a, max(time) AS b FROM series)), wanted AS (SELECT series_id, time FROM targets CROSS JOIN (SELECT DISTINCT series_id FROM series))"


@query("J7_given_targets", f"WITH {_T} SELECT t.time, count(s.series_id) AS n, {rs('sum(s.value)', 4)} AS total FROM wanted t LEFT JOIN series s ON s.series_id = t.series_id AND s.time = t.time GROUP BY 1")
def _(spark, sf_dir):
    at = al.exact(series(spark, sf_dir), _targets(spark, sf_dir))
    return at.groupBy("time").agg(F.count("value").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("J8_shift_start", "SELECT user_id, strftime(date_trunc('day', m) + INTERVAL 1 DAY * ((7 - (isodow(m) - 1)) % 7) + INTERVAL 9 HOUR + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS start FROM (SELECT user_id, min(ts) AS m FROM events GROUP BY 1)")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("m"))
    return e.select("user_id", F.date_format(dt.shift_start(F.col("m"), 9, 30, 0, 1), "yyyy-MM-dd HH:mm:ss").alias("start"))


_ASOF = f"WITH {_T} SELECT t.series_id, t.time, s.value, coalesce(s.time = t.time, false) AS is_real FROM wanted t ASOF LEFT JOIN series s ON t.series_id = s.series_id AND t.time >= s.time"


@query("J9_as_of", _ASOF.replace(", coalesce(s.time = t.time, false) AS is_real", ""))
def _(spark, sf_dir):
    return al.as_of(series(spark, sf_dir), _targets(spark, sf_dir)).select("series_id", "time", "value")


@query("J10_exact", f"WITH {_T} SELECT t.series_id, t.time, s.value FROM wanted t LEFT JOIN series s ON t.series_id = s.series_id AND t.time = s.time")
def _(spark, sf_dir):
    return al.exact(series(spark, sf_dir), _targets(spark, sf_dir))


@query("J11_mark_real", _ASOF)
def _(spark, sf_dir):
    return al.as_of(series(spark, sf_dir), _targets(spark, sf_dir))


@query(
    "J12_no_extrapolation",
    f"WITH {_T}, a AS (SELECT t.series_id, t.time, s.value, coalesce(s.time = t.time, false) AS is_real FROM wanted t ASOF LEFT JOIN series s ON t.series_id = s.series_id AND t.time >= s.time), "
    "l AS (SELECT a.*, a.time < m.last OR a.time = min(CASE WHEN a.time >= m.last THEN a.time END) OVER (PARTITION BY a.series_id) AS keep FROM a JOIN (SELECT series_id, max(time) AS last FROM series GROUP BY 1) m USING (series_id)) "
    "SELECT series_id, time, CASE WHEN keep THEN value END AS value, is_real AND keep AS is_real FROM l",
)
def _(spark, sf_dir):
    return al.as_of(series(spark, sf_dir), _targets(spark, sf_dir), extend_last=False)


_RAW = "SELECT event_type AS series_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS time, round(value, 1) AS value, event_id FROM events"


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), hour.alias("time"), F.round("value", 1).alias("value"), "event_id")


@query("J13_drop_duplicates", f"SELECT series_id, time, event_id FROM (SELECT *, row_number() OVER (PARTITION BY series_id, time ORDER BY event_id) AS n FROM ({_RAW})) WHERE n = 1")
def _(spark, sf_dir):
    return al.drop_duplicates(_raw(spark, sf_dir), "event_id", whole_rows=False).select("series_id", "time", "event_id")


@query("J13_drop_duplicate_rows", f"SELECT series_id, time, event_id FROM (SELECT *, row_number() OVER (PARTITION BY series_id, time, value ORDER BY event_id DESC) AS n FROM ({_RAW})) WHERE n = 1")
def _(spark, sf_dir):
    return al.drop_duplicates(_raw(spark, sf_dir), "event_id", keep="last").select("series_id", "time", "event_id")


@query("J13_repeats", f"SELECT series_id, count(*) - count(DISTINCT time) AS repeats FROM ({_RAW}) GROUP BY 1 HAVING count(*) > count(DISTINCT time)")
def _(spark, sf_dir):
    return al.repeats(_raw(spark, sf_dir))


@query("J4_upsert", f"WITH {NEW_OLD} SELECT series_id, time, coalesce(n.value, o.value) AS value FROM newer n FULL JOIN older o USING (series_id, time)")
def _(spark, sf_dir):
    """Stored by week, then put over twice, each time with a part of the new values."""
    new, old = new_and_old(spark, sf_dir)
    path, late = scratch(spark, "series"), F.dayofmonth("time") > 22
    for part in (old, new.filter(~late), new.filter(late)):
        io.upsert(part, path, period="week")
    return spark.read.parquet(path).select("series_id", "time", "value")


@query(
    "J14_last_known_index",
    f"WITH {_T}, n AS (SELECT series_id, time, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS n FROM series) SELECT t.series_id, t.time AS target, coalesce(n.n, -1) AS at FROM wanted t ASOF LEFT JOIN n ON t.series_id = n.series_id AND t.time >= n.time",
)
def _(spark, sf_dir):
    s = series(spark, sf_dir)
    wanted = al.exact(s, _targets(spark, sf_dir)).select("series_id", F.col("time").alias("target"))
    return al.last_known_index(wanted, s.select("series_id", F.col("time").alias("source")))


@query("J15_side_by_side", "SELECT n_nationkey, c, s FROM (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS s FROM supplier GROUP BY 1) USING (n_nationkey)")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("c"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("s"))
    return al.side_by_side(a, b, "n_nationkey")


@query("J16_new_information", f"WITH {NEW_OLD} SELECT n.series_id, n.time, CASE WHEN o.value IS NULL OR abs(n.value - o.value) > 1e-8 THEN n.value END AS value FROM newer n LEFT JOIN older o ON n.series_id = o.series_id AND n.time = o.time")
def _(spark, sf_dir):
    return al.new_information(*new_and_old(spark, sf_dir))


_MONTHS = "SELECT unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM b"
_ANCHORS = {
    "yy/5/15": "SELECT make_date(y, 5, 15) AS anchor FROM (SELECT unnest(range(year(lo), year(hi) + 1)) AS y FROM b)",
    "mm/1": f"SELECT CAST(m AS DATE) AS anchor FROM ({_MONTHS})",
    "mm/24": f"SELECT CAST(m AS DATE) + 23 AS anchor FROM ({_MONTHS})",
    "ww4-3": "SELECT min(date) AS anchor FROM ww, b WHERE meets AND NOT (SELECT bool_or(meets) FROM ww, b WHERE date = lo AND date_trunc('month', ww.date) = month) GROUP BY month",
}


def _rules_sql(rules: list[str], n: int, every: bool) -> str:
    """Rules by number; ww: dates in the fourth week or later, from Thursday on."""
    hits = " UNION ALL ".join(
        f"SELECT DISTINCT {j} AS rule, (SELECT min(n) FROM days WHERE date >= anchor) + {n - 1} AS n FROM ({_ANCHORS[x]}), b WHERE anchor >= lo" for j, x in enumerate(rules)
    )
    return (
        "WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), b AS (SELECT min(date) AS lo, max(date) AS hi FROM d), days AS (SELECT date, row_number() OVER (ORDER BY date) AS n FROM d), "
        "ww AS (SELECT date, date_trunc('month', date) AS month, CAST(strftime(date, '%W') AS INT) - CAST(strftime(date_trunc('month', date), '%W') AS INT) + 1 >= 4 AND isodow(date) - 1 >= 3 AS meets FROM d), "
        f"hits AS ({hits}), met AS (SELECT n, count(*) AS k FROM hits GROUP BY n) SELECT days.date, coalesce(met.k >= {len(rules) if every else 1}, false) AS flag FROM days LEFT JOIN met ON met.n = days.n"
    )


#: Name -> rules as given, the same one by one, the number of the date, and whether all have to be met.
_RULES = {
    "J17_yearly_rule": ("yy/5/15", ["yy/5/15"], 3, False),
    "J17_monthly_rule": ("mm/1", ["mm/1"], 2, False),
    "J17_weekly_rule": ("ww4-3", ["ww4-3"], 1, False),
    "J17_any_of_rules": (["yy/5/15", "mm/1"], ["yy/5/15", "mm/1"], 2, False),
    "J17_all_of_rules": (["mm/24", "ww4-3"], ["mm/24", "ww4-3"], 1, True),
    "J17_rules_in_one_string": ("yy/5/15mm/1ww4-3", ["yy/5/15", "mm/1", "ww4-3"], 1, False),
}


def _add_rule(name: str, given: str | list[str], each: list[str], n: int, every: bool) -> None:
    @query(name, _rules_sql(each, n, every))
    def _(spark, sf_dir):
        return pn.dates_by_rule(table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")), given, n, every)


for _name, _args in _RULES.items():
    _add_rule(_name, *_args)


@query("J18_week_of_month", "SELECT DISTINCT CAST(l_shipdate AS DATE) AS date, CAST(strftime(l_shipdate, '%W') AS BIGINT) - CAST(strftime(date_trunc('month', l_shipdate), '%W') AS BIGINT) + 1 AS week FROM lineitem")
def _(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    return d.select("date", dt.week_of_month(F.col("date")).alias("week"))


@query("P11_restrict", "SELECT event_id FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) <= DATE '2024-01-20' AND isodow(ts) IN (1, 3)")
def _(spark, sf_dir):
    import datetime

    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("date").alias("time"))
    return pn.restrict(e, "time", datetime.date(2024, 1, 5), datetime.date(2024, 1, 20), [1, 3]).select("event_id")


@query("P6_is_numeric", "SELECT event_id, TRY_CAST(event_type AS DOUBLE) IS NOT NULL AS kind_is_number, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) IS NOT NULL AS value_is_number FROM events")
def _(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", is_numeric(F.col("event_type")).alias("kind_is_number"), is_numeric(F.col("value").cast("string")).alias("value_is_number"))


# cleaning and correlation


def _event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers, so that ends really stand still."""
    return events_dense(spark, sf_dir).select(F.col("asset").alias("series_id"), "i", F.floor(F.col("x") / 40).cast("double").alias("value"))


_ESERIES = f"{EVENTS}, s AS (SELECT asset AS series_id, i, CAST(floor(x / 40) AS DOUBLE) AS value FROM edense)"


@query(
    "T5_trim_idle",
    f"WITH {_ESERIES}, e AS (SELECT series_id, min(i) AS ia, max(i) AS iz, arg_min(value, i) AS a, arg_max(value, i) AS z, min(value) != max(value) AS varies FROM s WHERE value IS NOT NULL GROUP BY 1), "
    "b AS (SELECT s.series_id, min(CASE WHEN i > ia AND (value IS NULL OR value != a) THEN i END) - 1 AS lo, max(CASE WHEN i < iz AND (value IS NULL OR value != z) THEN i END) + 1 AS hi FROM s JOIN e USING (series_id) GROUP BY 1) "
    "SELECT s.series_id, s.i, CASE WHEN varies AND s.i BETWEEN lo AND hi THEN value END AS value FROM s LEFT JOIN e USING (series_id) LEFT JOIN b USING (series_id)",
)
def _(spark, sf_dir):
    return al.trim_idle(_event_series(spark, sf_dir)).select("series_id", "i", "value")


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of the panel's assets, by nation and thousands of suppliers: many universes of at most a thousand series."""
    universe = F.concat_ws("-", "s_nationkey", F.floor(F.col("s_suppkey") / 1000))
    s = stock(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), universe.alias("universe")), "asset")
    d = s.select("universe", F.col("asset").alias("series_id"), "i", r(w.nav2ret(F.col("close"), F.col("i"), w.by_asset(order="i")), 10).alias("ret"))
    return d.filter("i > 0")


_RETURNS = (
    f"{STOCK}, ret AS (SELECT * FROM (SELECT s_nationkey || '-' || CAST(floor(s_suppkey / 1000) AS BIGINT) AS universe, asset AS series_id, i, {rs('close / lag(close) OVER (PARTITION BY asset ORDER BY i) - 1', 10)} AS ret "
    "FROM stock JOIN supplier ON s_suppkey = asset) WHERE i > 0)"
)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cl.pairwise_blocked(_returns(spark, sf_dir), universe="universe").select("universe", "a", "b", r("corr", 9).alias("corr"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of the nations' mean prices: one universe of twenty-five series."""
    s = stock(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.col("s_nationkey").cast("long").alias("series_id")), "asset")
    d = s.groupBy("series_id", "i").agg(r(F.avg("close")).alias("close"))
    return d.select("series_id", "i", r(w.nav2ret(F.col("close"), F.col("i"), w.by_asset("series_id", order="i")), 10).alias("ret")).filter("i > 0")


_CORR = rs("coalesce(corr(x.ret, y.ret), -1)", 9)
_NATIONS_SQL = (
    f"WITH {STOCK}, n AS (SELECT CAST(s_nationkey AS BIGINT) AS series_id, i, {rs('avg(close)')} AS close FROM stock JOIN supplier ON s_suppkey = asset GROUP BY 1, 2), "
    f"ret AS (SELECT * FROM (SELECT series_id, i, {rs('close / lag(close) OVER (PARTITION BY series_id ORDER BY i) - 1', 10)} AS ret FROM n) WHERE i > 0) "
    f"SELECT x.series_id AS a, y.series_id AS b, {_CORR} AS corr FROM ret x JOIN ret y ON x.i = y.i GROUP BY 1, 2"
)


@query("T1_pairwise", _NATIONS_SQL)
def _(spark, sf_dir):
    return cl.pairwise(_nations(spark, sf_dir)).select("a", "b", r("corr", 9).alias("corr"))


@query("T1_pairwise_blocked", f"WITH {_RETURNS} SELECT x.universe, x.series_id AS a, y.series_id AS b, {_CORR} AS corr FROM ret x JOIN ret y ON x.i = y.i AND x.universe = y.universe GROUP BY 1, 2, 3")
def _(spark, sf_dir):
    return _pairs(spark, sf_dir)


def _greedy(name: str, cells: str) -> str:
    """CTE of cells (key, ids, m, t): ids in the order of joining (done) and the group number of each (nos), a series a step."""
    mean = lambda others: f"round(list_avg(list_transform({others}, lambda y: m[x || ':' || y])), 11)"
    best = lambda those, others: f"list_sort(list_transform({those}, lambda x: {{'v': -{mean(others)}, 'place': list_position(ids, x), 'x': x}}))[1].x"
    fits = "list_filter(rest, lambda x: list_min(list_transform(grp, lambda y: m[x || ':' || y])) > t)"
    return (
        f"{name}_all AS (SELECT key, ids, m, t, CAST([] AS BIGINT[]) AS done, CAST([] AS INTEGER[]) AS nos, CAST([] AS BIGINT[]) AS grp FROM {cells} UNION ALL "
        "SELECT key, ids, m, t, list_append(done, new), list_append(nos, CASE WHEN len(nos) = 0 THEN 0 ELSE nos[-1] + CAST(NOT joins AS INTEGER) END), CASE WHEN joins THEN list_append(grp, new) ELSE [new] END "
        f"FROM (SELECT *, len(fits) > 0 AS joins, CASE WHEN len(fits) > 0 THEN {best('fits', 'grp')} ELSE {best('rest', 'rest')} END AS new "
        f"FROM (SELECT *, {fits} AS fits FROM (SELECT *, list_filter(ids, lambda x: NOT list_contains(done, x)) AS rest FROM {name}_all WHERE len(done) < len(ids))))), "
        f"{name} AS (SELECT key, ids, m, t, done, nos FROM {name}_all WHERE len(done) = len(ids))"
    )


_CELL = "list(DISTINCT a ORDER BY a) AS ids, map_from_entries(list((a || ':' || b, corr))) AS m"
_PAIRS_SQL = f"WITH RECURSIVE {_RETURNS}, p AS (SELECT x.universe, x.series_id AS a, y.series_id AS b, {_CORR} AS corr FROM ret x JOIN ret y ON x.i = y.i AND x.universe = y.universe GROUP BY 1, 2, 3)"
_LEVEL_ROWS = "SELECT key, unnest(done) AS series_id, unnest(nos) AS no, unnest(range(len(done))) AS place FROM"
_TWO_LEVELS_SQL = (
    f"{_PAIRS_SQL}, c1 AS (SELECT universe AS key, {_CELL}, 0.2 AS t FROM p GROUP BY 1), {_greedy('l1', 'c1')}, r1 AS ({_LEVEL_ROWS} l1), "
    f"c2 AS (SELECT {{'u': key, 'no': no}} AS key, list(series_id ORDER BY place) AS ids, any_value(m) AS m, 0.6 AS t FROM r1 JOIN (SELECT key, m FROM l1) USING (key) GROUP BY 1), {_greedy('l2', 'c2')}, "
    f"r2 AS ({_LEVEL_ROWS} l2), placed AS (SELECT key.u AS universe, series_id, row_number() OVER (PARTITION BY key.u ORDER BY key.no, place) - 1 AS order_no, CASE WHEN count(*) OVER (PARTITION BY key.u) > 1 THEN [key.no, no] ELSE [no] END AS path FROM r2)"
)


@query("T2_one_level", f"{_PAIRS_SQL}, c AS (SELECT universe AS key, {_CELL}, 0.2 AS t FROM p GROUP BY 1), {_greedy('l', 'c')} SELECT key AS universe, series_id, place AS order_no, [no] AS path FROM ({_LEVEL_ROWS} l)")
def _(spark, sf_dir):
    return cl.grouped(_pairs(spark, sf_dir), [0.2], "universe")


@query(
    "T2_by_rounds",
    _NATIONS_SQL.replace("WITH", "WITH RECURSIVE", 1).replace("SELECT x.series_id AS a", "p AS (SELECT x.series_id AS a").replace("i > 0) p AS", "i > 0), p AS")
    + f"), c AS (SELECT 0 AS key, {_CELL}, 0.3 AS t FROM p), {_greedy('l', 'c')} SELECT series_id, place AS order_no, [no] AS path FROM ({_LEVEL_ROWS} l)",
)
def _(spark, sf_dir):
    """The nations' mean prices, a universe of twenty-five series, where a task takes eight."""
    return cl.grouped(cl.pairwise(_nations(spark, sf_dir)).select("a", "b", r("corr", 9).alias("corr")), [0.3], most=8)


@query("T3_two_levels", f"{_TWO_LEVELS_SQL} SELECT * FROM placed")
def _(spark, sf_dir):
    return cl.grouped(_pairs(spark, sf_dir), [0.2, 0.6], "universe")


@query(
    "T7_two_levels",
    f"{_TWO_LEVELS_SQL} SELECT p.universe, p.a, p.b, x.order_no AS row_no, y.order_no AS col_no, nullif(corr, -1) AS corr FROM p JOIN placed x ON p.universe = x.universe AND p.a = x.series_id JOIN placed y ON p.universe = y.universe AND p.b = y.series_id",
)
def _(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return cl.sorted_matrix(pairs, cl.grouped(pairs, [0.2, 0.6], "universe"), "universe")


@query("T3_many_levels")
def _(spark, sf_dir):
    return cl.grouped(_pairs(spark, sf_dir), universe="universe")


@query(
    "T4_threshold",
    f"{_PAIRS_SQL}, c0 AS (SELECT universe, {_CELL}, min(corr) AS low, max(corr) AS high FROM p GROUP BY 1), "
    "c AS (SELECT {'u': universe, 'k': k} AS key, ids, m, CASE WHEN k = 20 THEN high ELSE k * ((high - low) / 20) + low END AS t FROM c0, (SELECT unnest(range(21)) AS k)), "
    f"{_greedy('l', 'c')}, rows AS ({_LEVEL_ROWS} l), means AS (SELECT x.key, avg(corr) AS mean FROM rows x JOIN rows y ON x.key = y.key AND x.no = y.no JOIN p ON p.universe = x.key.u AND p.a = x.series_id AND p.b = y.series_id GROUP BY 1), "
    "q AS (SELECT key.u AS universe, key.k AS k, t, mean, -nos[-1] AS number FROM l JOIN means USING (key)), "
    "s AS (SELECT universe, k, t, round((mean - min(mean) OVER w) / coalesce(nullif(max(mean) OVER w - min(mean) OVER w, 0), 1) + (number - min(number) OVER w) / coalesce(nullif(max(number) OVER w - min(number) OVER w, 0), 1), 11) AS score FROM q WINDOW w AS (PARTITION BY universe)) "
    f"SELECT universe, {rs('arg_max(t, (score, -k))', 9)} AS threshold FROM s GROUP BY 1",
)
def _(spark, sf_dir):
    return cl.chosen_threshold(_pairs(spark, sf_dir), "universe").select("universe", r("threshold", 9).alias("threshold"))


@query(
    "T6_rescaled",
    f"WITH RECURSIVE {_ESERIES}, x AS (SELECT CAST(floor(series_id / 200) AS BIGINT) AS universe, series_id, i AS t, value + 1 AS v FROM s), "
    "days AS (SELECT universe, t, row_number() OVER (PARTITION BY universe ORDER BY t) - 1 AS i FROM (SELECT DISTINCT universe, t FROM x)), "
    "d AS (SELECT a.universe, a.series_id, days.i, t, v FROM (SELECT DISTINCT universe, series_id FROM x) a JOIN days USING (universe) LEFT JOIN x USING (universe, series_id, t)), "
    "e AS (SELECT *, CASE WHEN v IS NOT NULL AND lag(v) OVER w IS NULL THEN i END AS start, last_value(v IGNORE NULLS) OVER everything AS last, max(CASE WHEN v IS NOT NULL THEN i END) OVER everything + 1 AS fin, "
    "min(CASE WHEN v IS NULL THEN i END) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM d WINDOW w AS (PARTITION BY series_id ORDER BY i), everything AS (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
    "f AS (SELECT *, CASE WHEN v IS NOT NULL THEN (last - v) / (fin - i) END AS step, max(start) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was, max(start) OVER (PARTITION BY series_id) AS final FROM e WINDOW w AS (PARTITION BY series_id ORDER BY i)), "
    "far AS (SELECT universe, i, series_id, stop, round(abs(step - avg(step) OVER (PARTITION BY universe, i)), 9) AS far FROM f WHERE step IS NOT NULL), "
    "best AS (SELECT universe, i, arg_min(series_id, (far, series_id)) AS series_id, arg_min(coalesce(stop, 1000000), (far, series_id)) AS stop FROM far GROUP BY 1, 2), "
    "ahead AS (SELECT b.universe, b.i, min(c.i) AS then FROM best b JOIN best c ON b.universe = c.universe AND c.i >= b.stop GROUP BY 1, 2), "
    "chain AS (SELECT * FROM best WHERE (universe, i) IN (SELECT (universe, min(i)) FROM best GROUP BY universe) "
    "UNION ALL SELECT b.* FROM chain c JOIN ahead a ON c.universe = a.universe AND c.i = a.i JOIN best b ON b.universe = c.universe AND b.i = a.then), "
    "held AS (SELECT f.universe, f.i, f.v, f.was, g.v AS first FROM f JOIN chain c ON f.universe = c.universe AND f.series_id = c.series_id AND f.i >= c.i AND f.i < c.stop LEFT JOIN f g ON g.series_id = f.series_id AND g.i = f.was), "
    "levels AS (SELECT universe, i, v AS level FROM held WHERE was IS NULL UNION ALL SELECT h.universe, h.i, h.v * (l.level / nullif(h.first, 0)) FROM levels l JOIN held h ON h.universe = l.universe AND h.was = l.i) "
    f"SELECT f.universe, f.series_id, f.t AS i, {rs('f.v * (l.level / nullif(g.v, 0))')} AS value FROM f LEFT JOIN levels l ON l.universe = f.universe AND l.i = f.final LEFT JOIN f g ON g.series_id = f.series_id AND g.i = f.final",
)
def _(spark, sf_dir):
    """Users in universes of two hundred."""
    series = _event_series(spark, sf_dir).select("series_id", "i", (F.col("value") + 1).alias("value"), F.floor(F.col("series_id") / 200).alias("universe"))
    return cl.rescaled(series, "universe").select("universe", "series_id", "i", r("value").alias("value"))


@query("T7_sorted_matrix")
def _(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return cl.sorted_matrix(pairs, cl.grouped(pairs, universe="universe"), "universe")


@query("T7_matrix")
def _(spark, sf_dir):
    pairs = _pairs(spark, sf_dir)
    return cl.matrix_rows(cl.sorted_matrix(pairs, cl.grouped(pairs, universe="universe"), "universe"), "universe")


_MEAN = (
    f"{PORTFOLIO}, m AS (SELECT i, coalesce(avg(r), 0) AS r FROM (SELECT i, CASE WHEN i = 0 THEN 0 ELSE close / lag(close) OVER (PARTITION BY deal ORDER BY i) - 1 END AS r FROM portfolio) GROUP BY 1), "
    "nav AS (SELECT i, product(1 + r) OVER (ORDER BY i) AS v FROM m)"
)


@query("A14_attach_mean", f"WITH {_MEAN}, lim AS (SELECT (SELECT min(i) FROM nav WHERE v != (SELECT v FROM nav ORDER BY i LIMIT 1)) - 1 AS lo, (SELECT max(i) FROM nav WHERE v != (SELECT v FROM nav ORDER BY i DESC LIMIT 1)) + 1 AS hi) SELECT deal AS series_id, i, close AS value FROM portfolio UNION ALL SELECT 'mean', i, CASE WHEN i BETWEEN lo AND hi THEN {rs('v')} END FROM nav CROSS JOIN lim")
def _(spark, sf_dir):
    p = portfolio(spark, sf_dir).select(F.col("deal").alias("series_id"), "i", F.col("close").alias("value"))
    return al.attach_mean(p).select("series_id", "i", F.when(F.col("series_id") == "mean", r("value")).otherwise(F.col("value")).alias("value"))


# sorts, sets, dates, text


@query("S1_rank_no_equal", "SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY floor(c_acctbal / 1000), c_custkey) AS place FROM customer")
def _(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.floor(F.col("c_acctbal") / 1000), "c_custkey")).cast("long").alias("place"))


@query("S2_sorted", "SELECT c_custkey, c_name FROM customer")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_name")


@query("S3_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("S3_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def _(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))).distinct()


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))), lambda x: x.l_partkey).alias("parts"))
    return li


_LINES = "SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY 1"


@query("S4_same_list", f"SELECT l_orderkey, parts = list_sort(parts) AS same FROM ({_LINES})")
def _(spark, sf_dir):
    return _lines(spark, sf_dir).select("l_orderkey", tx.same_list(F.col("parts"), F.sort_array("parts")).alias("same"))


@query("S5_pick", f"SELECT l_orderkey, CAST(parts[1] AS VARCHAR) || ', ' || CAST(coalesce(parts[3], -1) AS VARCHAR) AS picked FROM ({_LINES})")
def _(spark, sf_dir):
    picked = tx.pick(F.col("parts"), F.array(F.lit(0), F.lit(2)))
    return _lines(spark, sf_dir).select("l_orderkey", tx.list_to_line(F.transform(picked, lambda x: F.coalesce(x, F.lit(-1)))).alias("picked"))


@query("S6_stack", "SELECT n_nationkey AS k, n_name AS name, CAST(NULL AS DOUBLE) AS acctbal FROM nation UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def _(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("acctbal"))
    return a.unionByName(b, allowMissingColumns=True)


_STAMP = "yyyy-MM-dd HH:mm:ss"
_SERIAL = "(CAST(l_shipdate AS DATE) - DATE '1899-12-30') + (l_linenumber % 8) / 8.0"


def _serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    serial = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1899-12-30").cast("date")) + F.pmod("l_linenumber", F.lit(8)) / 8
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", serial.alias("serial"))


_TIME = "strftime(make_timestamp(epoch_us(TIMESTAMP '1899-12-30') + CAST(round(serial * 86400) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS time"


@query("D1_excel_serial", f"SELECT l_orderkey, l_linenumber, {_TIME} FROM (SELECT l_orderkey, l_linenumber, {_SERIAL} AS serial FROM lineitem)")
def _(spark, sf_dir):
    return _serial(spark, sf_dir).select("l_orderkey", "l_linenumber", F.date_format(dt.excel_to_timestamp(F.col("serial")), _STAMP).alias("time"))


@query("D2_matlab_serial", f"SELECT l_orderkey, l_linenumber, {_TIME} FROM (SELECT l_orderkey, l_linenumber, {_SERIAL} AS serial FROM lineitem)")
def _(spark, sf_dir):
    return _serial(spark, sf_dir).select("l_orderkey", "l_linenumber", F.date_format(dt.matlab_to_timestamp(F.col("serial") + dt.MATLAB_OFFSET), _STAMP).alias("time"))


@query("D3_split_yyyymmdd", "SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day FROM orders")
def _(spark, sf_dir):
    number = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", *[c.alias(k) for k, c in dt.split_yyyymmdd(number).items()])


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates written in five ways."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("t"))
    f = lambda p: F.date_format("t", p)
    way = F.pmod("o_orderkey", F.lit(5))
    text = F.when(way == 0, f("yyyy-M-d")).when(way == 1, f("yyyy/M/d H:mm")).when(way == 2, f("yyyyMMdd")).when(way == 3, F.datediff("t", F.lit("1899-12-30").cast("date")).cast("string"))
    return d.select("o_orderkey", text.otherwise(f("yyyy-M-d H:mm:ss")).alias("text"))


@query("D4_guess_format", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'y-m-d' WHEN 1 THEN 'y/m/d h:m' WHEN 2 THEN 'yyyymmdd' WHEN 3 THEN 'excel' ELSE 'y-m-d h:m:s' END AS kind FROM orders")
def _(spark, sf_dir):
    return _written(spark, sf_dir).select("o_orderkey", dt.guess_format(F.col("text")).alias("kind"))


@query("D5_parse_time", "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS day FROM orders")
def _(spark, sf_dir):
    d = _written(spark, sf_dir)
    return d.select("o_orderkey", F.date_format(dt.parse_time(F.col("text"), dt.guess_format(F.col("text"))), "yyyy-MM-dd").alias("day"))


@query("D6_next_weekday", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(CASE WHEN isodow(o_orderdate) < 3 THEN 3 - isodow(o_orderdate) ELSE 10 - isodow(o_orderdate) END AS INT) AS next FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", dt.next_weekday(F.col("o_orderdate").cast("date"), 3).alias("next"))


@query("D7_weekday", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM orders")
def _(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.weekday(F.col("o_orderdate").cast("date")).alias("weekday"))


@query("D8_any_time", "SELECT o_orderkey, strftime(date_trunc('day', o_orderdate), '%Y-%m-%d') AS day FROM orders")
def _(spark, sf_dir):
    return _written(spark, sf_dir).select("o_orderkey", F.date_format(dt.any_time(F.col("text")), "yyyy-MM-dd").alias("day"))


@query(
    "N1_path_parts",
    r"SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '\.([^.]*)$', 1) AS extension, "
    r"regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '') AS proper, regexp_extract(regexp_extract(url, '^(.*)/[^/]*$', 1), '([^/]*)$', 1) AS folder, regexp_replace(url, '(/[^/]*){2}$', '') AS up FROM pages",
)
def _(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", tx.file_name(u).alias("name"), tx.file_extension(u).alias("extension"), tx.proper_name(u).alias("proper"), tx.folder_name(u).alias("folder"), tx.levels_up(u, 2).alias("up"))


@query("N2_map_to_line", "SELECT c_custkey, 'key: ' || c_custkey || ', name: ' || c_name || ', segment: ' || c_mktsegment AS line FROM customer")
def _(spark, sf_dir):
    m = F.create_map(F.lit("name"), F.col("c_name"), F.lit("key"), F.col("c_custkey").cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.map_to_line(m).alias("line"))


@query("N3_sha1", "SELECT page_id, sha1(url) AS digest FROM pages")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.sha1(F.col("url").cast("binary")).alias("digest"))


@query("N4_file_digests", "SELECT CAST(c_nationkey AS INT) AS nation, sha1(string_agg(c_name || chr(10), '' ORDER BY c_custkey)) AS sha1 FROM customer GROUP BY 1")
def _(spark, sf_dir):
    """A file of names for each nation."""
    folder = scratch(spark, "names")
    c = table(spark, sf_dir, "customer").repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey")
    c.select("c_nationkey", F.col("c_name").alias("value")).write.partitionBy("c_nationkey").text(folder)
    found = io.file_digests(spark, folder).filter(F.startswith("name", F.lit("part-")))
    return found.select(F.regexp_extract("path", "c_nationkey=([0-9]+)/", 1).cast("int").alias("nation"), "sha1")


_FRAMED = lambda *v: " || ".join(f"coalesce(length({x}) || ':' || {x}, '-')" for x in v)


@query("N5_fingerprint", f"SELECT c_custkey, sha1(sha1('4:name6:nation7:segment') || sha1({_FRAMED('c_name', 'CAST(nullif(c_nationkey, 3) AS VARCHAR)', 'c_mktsegment')})) AS digest FROM customer")
def _(spark, sf_dir):
    values = [F.col("c_name"), F.nullif("c_nationkey", F.lit(3)), F.col("c_mktsegment")]
    return table(spark, sf_dir, "customer").select("c_custkey", tx.fingerprint([F.lit(x) for x in ("name", "nation", "segment")], values).alias("digest"))


# dependency tables: a part depends on the parts at half and a third of its number


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    halves = F.array_distinct(F.filter(F.array(F.floor(k / 10), F.floor(k / 15)), lambda x: x >= 1))
    return table(spark, sf_dir, "part").select(k.cast("string").alias("task"), F.array_join(F.transform(halves, lambda x: x.cast("string")), ", ").alias("depends_on"))


_EDGES = "edges AS (SELECT DISTINCT p_partkey AS task, d AS depends_on FROM (SELECT p_partkey, unnest([p_partkey // 10, p_partkey // 15]) AS d FROM part) WHERE d >= 1)"


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tasks = _tasks(spark, sf_dir)
    return tasks.select("task"), gr.edges(tasks)


@query("G1_edges", f"WITH {_EDGES} SELECT CAST(task AS VARCHAR) AS task, CAST(depends_on AS VARCHAR) AS depends_on FROM edges")
def _(spark, sf_dir):
    return gr.edges(_tasks(spark, sf_dir))


@query("G2_impact", f"WITH RECURSIVE {_EDGES}, reach AS (SELECT p_partkey AS task, p_partkey AS affects FROM part UNION SELECT reach.task, edges.task FROM reach JOIN edges ON edges.depends_on = reach.affects) SELECT CAST(task AS VARCHAR) AS task, CAST(affects AS VARCHAR) AS affects FROM reach")
def _(spark, sf_dir):
    return gr.impact(*_graph(spark, sf_dir))


@query("G3_levels", f"WITH RECURSIVE {_EDGES}, walk AS (SELECT p_partkey AS task, 0 AS level FROM part UNION SELECT edges.task, level + 1 FROM walk JOIN edges ON edges.depends_on = walk.task) SELECT CAST(task AS VARCHAR) AS task, CAST(max(level) AS BIGINT) AS level FROM walk GROUP BY 1")
def _(spark, sf_dir):
    return gr.levels(*_graph(spark, sf_dir))


@query("G4_violations", f"WITH {_EDGES} SELECT CAST(task AS VARCHAR) AS task, CAST(depends_on AS VARCHAR) AS depends_on FROM edges WHERE (depends_on * 7919) % 10007 >= (task * 7919) % 10007")
def _(spark, sf_dir):
    nodes, e = _graph(spark, sf_dir)
    return gr.violations(nodes.withColumn("position", F.pmod(F.col("task").cast("long") * 7919, F.lit(10007))), e)


# files: tables written as CSV by Spark in the shared folder, then read as foreign files


def _csv_folder(spark: SparkSession, sf_dir: str) -> str:
    """A file for each event type, without a header, in a folder of its own."""
    d = table(spark, sf_dir, "events").select("event_type", F.date_format(F.col("ts").cast("timestamp"), "yyyy/M/d H:mm").alias("t"), F.col("value").cast("string").alias("v"), F.col("event_id").cast("string").alias("w"))
    folder = scratch(spark, "series")
    d.repartition("event_type").write.partitionBy("event_type").csv(folder)
    return folder


_MEASURES = ("close", "market_cap", "pb_ratio", "roe", "qty")


@query("IO1_load_panel", f"WITH {STOCK} SELECT asset, date, {', '.join(_MEASURES)} FROM cells")
def _(spark, sf_dir):
    """Each measure as a table of its own, put together again."""
    c = cut(cells(spark, sf_dir))
    return pn.check_same_shape({m: c.select("asset", "date", F.col(m).alias("value")) for m in _MEASURES})


@query("IO1_wide_to_long", f"WITH {STOCK} " + " UNION ALL ".join(f"SELECT asset, date, '{m}' AS measure, CAST({m} AS DOUBLE) AS value FROM cells" for m in _MEASURES))
def _(spark, sf_dir):
    return pn.wide_to_long(cells(spark, sf_dir).select("asset", "date", *_MEASURES), ["asset", "date"], "measure").select("asset", "date", "measure", "value")


@query("IO2_load_funds", f"WITH {PORTFOLIO} SELECT deal, date, {rs('coalesce(close / lag(close) OVER (PARTITION BY deal ORDER BY i) - 1, 0)')} AS ret FROM portfolio")
def _(spark, sf_dir):
    return portfolio(spark, sf_dir).select("deal", "date", r(w.reldiff(F.col("close"), w.by_asset("deal"))).alias("ret"))


@query("IO3_list_files", "SELECT DISTINCT event_type, CAST(1 AS BIGINT) AS n_files, true AS filled FROM events")
def _(spark, sf_dir):
    d = io.list_files(spark, _csv_folder(spark, sf_dir), "csv", skip_containing=["_SUCCESS"])
    return d.groupBy(F.regexp_extract("path", "event_type=([^/]*)", 1).alias("event_type")).agg(F.count(F.lit(1)).alias("n_files"), F.min(F.col("size") > 0).alias("filled"))


def _read(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The lines of the files, and their series by path."""
    raw = io.read_series(spark, _csv_folder(spark, sf_dir), ["t", "v", "w"], recursive=True)
    return raw, raw.select("path").distinct().select("path", F.regexp_extract("path", "event_type=([^/]*)", 1).alias("series_id"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw, names = _read(spark, sf_dir)
    return io.parse_series(raw, "t", ["v", "w"], names=names).select("series_id", F.date_format("time", "yyyy-MM-dd HH:mm").alias("time"), "field", "value")


_PARSED = "parsed AS (SELECT event_type AS series_id, strftime(ts, '%Y-%m-%d %H:%M') AS time, 'v' AS field, value FROM events UNION ALL SELECT event_type, strftime(ts, '%Y-%m-%d %H:%M'), 'w', CAST(event_id AS DOUBLE) FROM events)"


@query("IO4_read_series", "SELECT strftime(ts, '%Y/%-m/%-d %-H:%M') AS t, CAST(value AS DOUBLE) AS v, event_id AS w FROM events")
def _(spark, sf_dir):
    return _read(spark, sf_dir)[0].select("t", F.col("v").cast("double").alias("v"), F.col("w").cast("long").alias("w"))


@query("IO5_pick_columns", f"WITH {_PARSED} SELECT * FROM parsed")
def _(spark, sf_dir):
    return _parsed(spark, sf_dir)


_NAME = r"regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.[^.]*$', '')"
_SAME = "len(list_filter(range(1, len(a) + 1), lambda k: a[1:k] = z[1:k]))"


@query(
    "IO6_series_names",
    f"WITH u AS (SELECT DISTINCT url, {_NAME} AS name, string_split(url, '/')[1:-2] AS folders FROM pages), e AS (SELECT string_split(min(url), '/')[1:-2] AS a, string_split(max(url), '/')[1:-2] AS z FROM u), "
    f"s AS (SELECT {_SAME} AS same FROM e), n AS (SELECT name, count(*) AS n FROM u GROUP BY 1) "
    "SELECT url AS path, CASE WHEN n > 1 THEN array_to_string(list_append(folders[same + 1:], name), '_') ELSE name END AS series_id FROM u JOIN n USING (name) CROSS JOIN s",
)
def _(spark, sf_dir):
    """Pages' addresses as files' paths."""
    return io.series_names(table(spark, sf_dir, "pages"), "url")


@query("IO7_write_csv", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(spark, sf_dir):
    path, c = scratch(spark, "csv"), table(spark, sf_dir, "customer")
    io.write_csv(c, path)
    return spark.read.schema(c.schema).option("header", True).csv(path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("IO8_write_factor_means", ORACLES["A7_factor_means"])
def _(spark, sf_dir):
    path = scratch(spark, "means")
    io.write_results(cs.factor_mean_rows(spark, sf_dir), path, "period")
    return spark.read.parquet(path).select("period", "smb", "hml", "rmw", "cma")


@query("IO8_write_results")
def _(spark, sf_dir):
    path = scratch(spark, "results")
    io.write_results(cs.attribution_rows(spark, sf_dir), path, "deal")
    return spark.read.parquet(path).select("deal", "period", "term", "beta", "p_value")


_WIDE = ", ".join(f"max(CASE WHEN term = '{t}' THEN beta END) AS {t}" for t in TERMS)


@query("IO8_wide_betas", f"SELECT deal, period, {_WIDE} FROM ({ORACLES['A6_betas']}) GROUP BY 1, 2")
def _(spark, sf_dir):
    """A row for each deal and quarter, a column for each factor; written by deal and read again."""
    path = scratch(spark, "betas")
    rows = cs.attribution_rows(spark, sf_dir).filter("p_value is not null").withColumn("beta", r("beta", 4))
    io.write_results(io.wide_results(rows, ["deal", "period"], "term", "beta", list(TERMS)), path, "deal")
    return spark.read.parquet(path).select("deal", "period", *TERMS)


def _stored(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    path = scratch(spark, by)
    io.write_results(_parsed(spark, sf_dir), path, by)
    return spark.read.schema("time string, field string, value double, series_id string").parquet(path).select("series_id", "field", "time", "value")


_STORED = f"WITH {_PARSED} SELECT series_id, field, time, value FROM parsed"


@query("IO9_store_by_field", _STORED)
def _(spark, sf_dir):
    return _stored(spark, sf_dir, "field")


@query("IO9_store_by_file", _STORED)
def _(spark, sf_dir):
    return _stored(spark, sf_dir, "series_id")


@query("IO9_everything", f"WITH {_PARSED}, m AS (SELECT series_id || '_' || field AS name, time, max(value) AS value FROM parsed GROUP BY 1, 2) SELECT time, name, value FROM (SELECT time, name FROM (SELECT DISTINCT time FROM m) CROSS JOIN (SELECT DISTINCT name FROM m)) LEFT JOIN m USING (time, name)")
def _(spark, sf_dir):
    """One frame, unpivoted again, as its columns follow from the data."""
    return pn.wide_to_long(io.one_frame(_parsed(spark, sf_dir)), ["time"], "name").select("time", "name", "value")


@query("IO10_as_map", "SELECT o_custkey, string_agg(o_orderkey || ': ' || o_orderpriority, ', ' ORDER BY CAST(o_orderkey AS VARCHAR)) AS line FROM orders GROUP BY 1")
def _(spark, sf_dir):
    """Each customer's orders as a lookup."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").cast("string").alias("k"), "o_orderpriority")
    return io.as_map(o, "k", "o_orderpriority", "o_custkey").select("o_custkey", tx.map_to_line(F.col("lookup")).alias("line"))

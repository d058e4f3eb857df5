"""Panels made from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, WindowSpec
from pyspark.sql import functions as F

from tallyfold.jobs.registry import r, rs
from tallyfold.operators.panel import densify
from tallyfold.operators.windows import by_asset, reldiff

def wa() -> WindowSpec:
    """An asset's rows in date order. Built when asked for: it needs a running session."""
    return by_asset()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """One row for each supplier and month (or week) that has line items."""
    li = table(spark, sf_dir, "lineitem")
    month = F.trunc(F.col("l_shipdate").cast("date"), unit).alias("date")
    return li.groupBy(F.col("l_suppkey").alias("asset"), month).agg(
        r(F.avg(F.col("l_extendedprice") / F.col("l_quantity"))).alias("close"),
        F.round(F.sum("l_extendedprice"), 2).alias("market_cap"),
        r(F.avg("l_discount"), 8).alias("pb_ratio"),
        r(F.avg("l_tax"), 8).alias("roe"),
        F.sum("l_quantity").alias("qty"),
    )


def stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel: asset, date, i, close, market_cap, pb_ratio, roe, qty, asset_growth."""
    d = densify(cells(spark, sf_dir))
    return d.withColumn("asset_growth", r(reldiff(F.col("qty"), wa()), 10))


CELLS = f"""cells AS (
  SELECT l_suppkey AS asset, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, {rs('avg(l_extendedprice / l_quantity)')} AS close,
    round(sum(l_extendedprice), 2) AS market_cap, {rs('avg(l_discount)', 8)} AS pb_ratio, {rs('avg(l_tax)', 8)} AS roe, sum(l_quantity) AS qty
  FROM lineitem GROUP BY 1, 2)"""

STOCK = f"""{CELLS}, cal AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM cells)), stock AS (
  SELECT a.asset, c.date, c.i, s.close, s.market_cap, s.pb_ratio, s.roe, s.qty,
    {rs('coalesce(s.qty / lag(s.qty) OVER (PARTITION BY a.asset ORDER BY c.i) - 1, 0)', 10)} AS asset_growth
  FROM cal c CROSS JOIN (SELECT DISTINCT asset FROM cells) a LEFT JOIN cells s ON s.asset = a.asset AND s.date = c.date)"""


def portfolio(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """A fund for each order priority: deal, date, i, close."""
    o = table(spark, sf_dir, "orders")
    c = o.groupBy(F.col("o_orderpriority").alias("deal"), F.trunc(F.col("o_orderdate").cast("date"), unit).alias("date")).agg(r(F.avg("o_totalprice")).alias("close"))
    return densify(c, asset="deal")


def fund_dates(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    """The funds' calendar."""
    return table(spark, sf_dir, "orders").select(F.trunc(F.col("o_orderdate").cast("date"), unit).alias("date")).distinct()


PORTFOLIO = f"""deals AS (
  SELECT o_orderpriority AS deal, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, {rs('avg(o_totalprice)')} AS close FROM orders GROUP BY 1, 2),
pcal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM deals)), portfolio AS (
  SELECT a.deal, c.date, c.i, s.close FROM pcal c CROSS JOIN (SELECT DISTINCT deal FROM deals) a LEFT JOIN deals s ON s.deal = a.deal AND s.date = c.date)"""


def risk_free(spark: SparkSession, sf_dir: str, unit: str = "month") -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.trunc(F.col("l_shipdate").cast("date"), unit).alias("date")).agg(r(F.avg("l_discount") / 1000, 8).alias("rf"))


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("asset"), F.col("ts").cast("date").alias("date")).agg(r(F.avg("value")).alias("x"))


def events_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day with real gaps: asset, date, i, x."""
    return densify(event_cells(spark, sf_dir))


EVENTS = f"""ecells AS (SELECT user_id AS asset, CAST(ts AS DATE) AS date, {rs('avg(value)')} AS x FROM events GROUP BY 1, 2),
ecal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT date FROM ecells)), edense AS (
  SELECT a.asset, c.date, c.i, s.x FROM ecal c CROSS JOIN (SELECT DISTINCT asset FROM ecells) a LEFT JOIN ecells s ON s.asset = a.asset AND s.date = c.date)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series for each event type, by hour: series_id, time (a number of hours), value."""
    e = table(spark, sf_dir, "events")
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600).cast("long")
    return e.groupBy(F.col("event_type").alias("series_id"), hour.alias("time")).agg(r(F.avg("value")).alias("value"))


SERIES = f"""series AS (SELECT event_type AS series_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS time, {rs('avg(value)')} AS value FROM events GROUP BY 1, 2)"""


def new_and_old(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping parts of the event panel; some new values differ."""
    e = event_cells(spark, sf_dir).select(F.col("asset").alias("series_id"), F.col("date").alias("time"), F.col("x").alias("value"))
    day = F.dayofmonth("time")
    changed = F.when(F.pmod(F.col("series_id"), F.lit(7)) == 0, F.col("value") * 1.5).when(F.pmod(F.col("series_id"), F.lit(7)) == 1, F.col("value") * 0.5).otherwise(F.col("value"))
    return e.filter(day >= 10).withColumn("value", r(changed)), e.filter(day <= 20)


NEW_OLD = f"""ecells AS (SELECT user_id AS series_id, CAST(ts AS DATE) AS time, {rs('avg(value)')} AS value FROM events GROUP BY 1, 2),
newer AS (SELECT series_id, time, {rs('CASE WHEN series_id % 7 = 0 THEN value * 1.5 WHEN series_id % 7 = 1 THEN value * 0.5 ELSE value END')} AS value FROM ecells WHERE day(time) >= 10),
older AS (SELECT * FROM ecells WHERE day(time) <= 20)"""

"""Performance of each series."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.cells import ratio_change
from tallyfold.operators.ordered import ROWS, Parts, by_splitters, largest, last, number, product, running


def annual_factor(n: Column, first: Column, last: Column) -> Column:
    """Rows in a year; 250 without dates or within one day."""
    days = F.datediff(last, first)
    return F.when(days > 0, n / (days / 365.25)).otherwise(F.lit(250.0))


def _drawdown(parts: Parts, nav: str) -> DataFrame:
    """parts.df with drawdown and below. Peaks and the last row at a peak are carried from part to part."""
    d = running(parts, {"_peak": largest(F.col(nav)), "_row": number(F.lit(True))})
    d = running(replace(parts, df=d), {"_at": largest(F.when(F.col(nav) >= F.col("_peak"), F.col("_row")))})
    drawdown = F.col("_peak") / F.nullif(F.col(nav), F.lit(0.0)) - 1
    return d.withColumns({"drawdown": drawdown, "below": F.col("_row") - F.coalesce("_at", F.lit(0))}).drop("_peak", "_row", "_at")


def drawdown_rows(df: DataFrame, nav: str = "nav", by: str = "series_id", order: str = "date", rows: int = ROWS) -> DataFrame:
    """Adds drawdown (peak / nav - 1) and below: how many rows in a row the value has been under its peak. A series of more than so many rows is many tasks."""
    return _drawdown(by_splitters(df, (by,), [F.col(order)], rows), nav).drop("_part")


def max_drawdown(df: DataFrame, nav: str = "nav", by: str = "series_id", order: str = "date", rows: int = ROWS) -> DataFrame:
    return drawdown_rows(df, nav, by, order, rows).groupBy(by).agg(F.max("drawdown").alias("max_dd"), F.max("below").alias("longest_below"))


def metrics(df: DataFrame, nav: str = "nav", by: str = "series_id", date: str = "date", is_return: bool = False, dated: bool = True, rows: int = ROWS) -> DataFrame:
    """One record for each series: annual return, volatility, Sharpe ratio, drawdown, return over drawdown, win rate, range.

    n values give n - 1 returns: the first has none. The win rate divides by one more than the number of returns, and
    the number of data is one more than that of dates, as the reference counts them. Not dated: the column is an order
    alone, a year has 250 rows, start, end and days are unknown, and the number of data is that of rows.
    """
    parts = by_splitters(df, (by,), [F.col(date)], rows)
    if is_return:
        d = running(parts, {"_nav": product(1 + F.coalesce(F.col(nav), F.lit(0.0)))}).withColumn("_ret", F.col(nav))
    else:
        d = running(parts, {"_before": last(F.col(nav), F.lit(True))}, before=True)
        d = d.withColumn("_ret", ratio_change(F.col(nav), F.col("_before.v"))).withColumn("_nav", F.col(nav)).drop("_before")
    d = _drawdown(replace(parts, df=d), "_nav")
    n = F.count(F.lit(1))
    base = d.groupBy(by).agg(
        F.min(date).alias("start"), F.max(date).alias("end"), n.alias("_n"), F.avg("_ret").alias("_mean"), F.stddev_pop("_ret").alias("_std"),
        F.max("drawdown").alias("max_dd"), F.max("below").alias("longest_below"), F.sum(F.when(F.col("_ret") >= 0, 1).otherwise(0)).alias("_won"), F.count("_ret").alias("_rets"),
    )
    if not dated:
        base = base.withColumns({c: F.lit(None).cast("date") for c in ("start", "end")})
    f = annual_factor(F.col("_n"), F.col("start"), F.col("end"))
    out = base.select("*", f.alias("ann_fac"), (F.col("_mean") * f).alias("ann_ret"), (F.col("_std") * F.sqrt(f)).alias("ann_vol"))
    return out.select(
        by, "ann_fac", "ann_ret", "ann_vol",
        (F.col("ann_ret") / F.nullif(F.col("ann_vol"), F.lit(0.0))).alias("sharpe"),
        "max_dd", "longest_below",
        (F.col("ann_ret") / F.nullif(F.col("max_dd"), F.lit(0.0))).alias("ret_dd"),
        (F.col("_won") / (F.col("_rets") + 1)).alias("win_rate"),
        "start", "end", F.datediff("end", "start").cast("long").alias("days"), (F.col("_n") + int(dated)).alias("n_data"),
    )

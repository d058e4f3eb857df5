"""Dense panels and calendars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.functions.dates import week_of_month
from tallyfold.operators.ordered import BLOCK, by_number, last_value, running
from tallyfold.sources.storage import cut, few

#: A calendar is handed to all executors; more dates than this are refused.
MAX_DATES = 1_000_000


def calendar(dates: DataFrame, date: str = "date") -> DataFrame:
    """One row: the distinct dates in order, as an array. More than MAX_DATES fail the job."""
    days = dates.filter(F.col(date).isNotNull()).select(date).distinct().agg(F.sort_array(F.collect_list(date)).alias("_dates"))
    kind = days.schema["_dates"].dataType
    refused = F.raise_error(F.lit(f"more than {MAX_DATES} dates")).cast(kind)
    return days.select(F.when(F.size("_dates") <= MAX_DATES, F.col("_dates")).otherwise(refused).alias("_dates"))


def densify(cells: DataFrame, dates: DataFrame | None = None, asset: str = "asset", date: str = "date") -> DataFrame:
    """Every asset on every date of the calendar (by default the cells' own), with i, the date's number; absent cells are NULL.

    Cells on other dates are dropped. The calendar is one row; each asset is expanded where it lies. The cells are worked
    out once and cut, as calendar, assets and values are read from them.
    """
    cells = cut(cells)
    days = calendar(cells if dates is None else dates, date)
    grid = cells.select(asset).distinct().crossJoin(F.broadcast(days)).select(asset, F.posexplode("_dates").alias("i", date))
    return grid.withColumn("i", F.col("i").cast("long")).join(cells, [asset, date], "left")


def align_keep(cells: DataFrame, dates: DataFrame, date: str = "date") -> DataFrame:
    """Adds calendar dates that the cells lack, as empty rows; keeps the cells' other dates. added tells which."""
    days = dates.select(F.col(date).alias(date)).distinct()
    return cells.withColumn("_in", F.lit(True)).join(days, date, "full_outer").withColumn("added", F.col("_in").isNull()).drop("_in")


def align_force(cells: DataFrame, dates: DataFrame, columns: list[str], asset: str = "asset", date: str = "date", block: int = BLOCK) -> DataFrame:
    """Exactly the calendar's dates for each asset, then filled forward: a dropped date's value is not carried."""
    days = cut(dates.select(date).distinct())
    d = densify(cells, days, asset, date).select(asset, date, "i", *[F.col(c).alias(f"_{c}") for c in columns])
    parts = by_number(d, (asset,), rows=block, most=days.count())
    return running(parts, {c: last_value(F.col(f"_{c}")) for c in columns}).drop("_part", *[f"_{c}" for c in columns])


def regular_dates(start: Column, end: Column, days: int) -> Column:
    """start, start + days, ... through the first that is not before end."""
    steps = F.ceil(F.greatest(F.datediff(end, start), F.lit(0)) / days).cast("int")
    return F.transform(F.sequence(F.lit(0), steps), lambda k: F.date_add(start, k * days))


def wide_to_long(wide: DataFrame, ids: list[str], name: str = "asset", value: str = "value") -> DataFrame:
    columns = [c for c in wide.columns if c not in ids]
    return wide.unpivot([F.col(c) for c in ids], [F.col(c).cast("double").alias(c) for c in columns], name, value)


def check_same_shape(measures: dict[str, DataFrame], keys: tuple[str, ...] = ("asset", "date")) -> DataFrame:
    """The measures as columns of one table; raises if they don't hold the same keys."""
    tagged = [d.select(*keys, F.lit(name).alias("_m"), F.col("value")) for name, d in measures.items()]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    joined = rows.groupBy(*keys).pivot("_m", list(measures)).agg(F.first("value"))
    counts = rows.groupBy(*keys).agg(F.countDistinct("_m").alias("n")).filter(F.col("n") != len(measures))
    if not counts.isEmpty():
        raise ValueError("the measures have different shapes")
    return joined


def fill_columns(df: DataFrame, columns: list[str], fill=None) -> DataFrame:
    """Choose and reorder columns; absent ones are filled."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(fill).alias(c) for c in columns])


def restrict(df: DataFrame, time: str = "time", start=None, end=None, weekdays: list[int] | None = None) -> DataFrame:
    """Rows from start to end, both included, and on chosen weekdays (1 = Monday)."""
    if start is not None:
        df = df.filter(F.col(time) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(time) <= F.lit(end))
    return df.filter((F.weekday(time) + 1).isin(weekdays)) if weekdays else df


def parsed_rules(rule: str | list[str]) -> list[tuple[str, list[int]]]:
    """(tag, numbers) of rules that stand in one string, one after the other, or in a list, or both: yy/5/15 each year, mm/1 each month, ww4-3 each month by week and weekday."""
    found = re.findall(r"([a-z]+)([^a-z]*)", "".join(rule))
    rules = [(tag, [int(x) for x in re.findall(r"\d+", rest)]) for tag, rest in found]
    sizes = {"yy": 2, "mm": 1, "ww": 2}
    for tag, numbers in rules:
        if sizes.get(tag) != len(numbers):
            raise ValueError(f"unknown rule {tag} {numbers}")
    if not rules:
        raise ValueError("no rule")
    return rules


def _places(days: DataFrame, tag: str, numbers: list[int], date: str) -> DataFrame:
    """(_at): places in the calendar, from 0, of the first date that each year or month gives a rule."""
    one = days.select("_dates", F.element_at("_dates", 1).alias("lo"), F.element_at("_dates", -1).alias("hi"))
    if tag == "ww":
        each = one.select("lo", F.posexplode("_dates").alias("_at", "day"))
        meets = lambda d: (week_of_month(d) >= numbers[0]) & (F.weekday(d) >= numbers[1])
        # Where the calendar's first date meets the rule, an earlier one of that month may be missing.
        begun = meets(F.col("lo")) & (F.trunc("day", "month") == F.trunc("lo", "month"))
        return each.filter(meets(F.col("day")) & ~begun).groupBy(F.trunc("day", "month").alias("month")).agg(F.min("_at").alias("_at")).select("_at")
    if tag == "yy":
        anchors = F.transform(F.sequence(F.year("lo"), F.year("hi")), lambda y: F.make_date(y, F.lit(numbers[0]), F.lit(numbers[1])))
    else:
        anchors = F.transform(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month")), lambda m: F.date_add(m, numbers[0] - 1))
    at = one.select("_dates", "lo", F.explode(anchors).alias("anchor")).filter(F.col("anchor") >= F.col("lo"))
    return at.select(F.size(F.filter("_dates", lambda x: x < F.col("anchor"))).alias("_at"))


def dates_by_rule(dates: DataFrame, rule: str | list[str], n: int = 1, every: bool = False, date: str = "date") -> DataFrame:
    """(date, flag): whether a date is, by any of the rules (by every one, if every), the n-th of the calendar from the first that the rule meets in each year or month.

    yy/m/d: on or after that day of each year; mm/d: of each month; wwk-d: in the month's k-th week or later, on weekday
    d or later, of which Monday is 0. A day before the first date is skipped, as is a result past the end. Each rule is a
    bit; the dates' bits are put together in one aggregation.
    """
    days, rules = calendar(dates, date), parsed_rules(rule)
    hits = None
    for j, (tag, numbers) in enumerate(rules):
        found = _places(days, tag, numbers, date).select((F.col("_at") + n - 1).alias("_at"), F.lit(1 << j).cast("long").alias("_bit"))
        hits = found if hits is None else hits.unionByName(found)
    bits = hits.groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))
    wanted = F.col("_bits") == (1 << len(rules)) - 1 if every else F.col("_bits") != 0
    numbered = days.select(F.posexplode("_dates").alias("_at", date))
    return numbered.join(bits, "_at", "left").select(date, F.coalesce(wanted, F.lit(False)).alias("flag"))


def wanted_assets(df: DataFrame, assets: DataFrame, columns: list[str], fill: float | None = None, asset: str = "asset", date: str = "date") -> DataFrame:
    """(asset, date, columns): exactly the wanted assets, in long form: others are dropped, absent ones get fill on each of df's dates, as does an asset on dates that it lacks.

    What is there stays, missing too. Dates and the wanted list meet as a grid, which is the size of the answer.
    """
    want, days = assets.select(asset).distinct(), df.select(date).distinct()
    grid = days.crossJoin(F.broadcast(want)) if few(want) else want.crossJoin(F.broadcast(days) if few(days) else days)
    there = df.select(asset, date, F.struct(*columns).alias("_row"))
    d = grid.join(there, [asset, date], "left")
    return d.select(asset, date, *[F.when(F.col("_row").isNull(), F.lit(fill)).otherwise(F.col("_row")[c]).alias(c) for c in columns])

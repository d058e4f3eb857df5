"""Cell-wise functions. Missing is NULL; NaN counts as missing wherever a value is read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def missing(x: Column) -> Column:
    return F.isnull(x) | F.isnan(x.cast("double"))


def known(x: Column) -> Column:
    """NaN to NULL."""
    return F.when(~F.isnan(x.cast("double")), x)


def is_true(x: Column) -> Column:
    """A condition with NULL taken as false."""
    return F.coalesce(x, F.lit(False))


def replace(x: Column, old, new) -> Column:
    """old (None or NaN: missing cells) replaced by new."""
    if old is None or old != old:
        return F.coalesce(known(x), F.lit(new).cast("double"))
    return F.when(x == F.lit(old), F.lit(new)).otherwise(x)


def replace_where(x: Column, condition: Column, new) -> Column:
    return F.when(is_true(condition), F.lit(new)).otherwise(x)


def divide(x: Column, by: Column, out=None) -> Column:
    """x / by; a divisor of 0 is replaced by out, so that NULL gives NULL."""
    return x / F.when(by == 0, F.lit(out).cast("double")).otherwise(by)


def ratio_change(x: Column, before: Column) -> Column:
    """x / before - 1, infinite with x's sign where before is 0, NULL for 0 / 0."""
    grown = F.when(x > 0, F.lit(INF)).when(x < 0, F.lit(-INF))
    return F.when(before == 0, grown).otherwise(x / F.when(before != 0, before) - 1)


def larger(a: Column, b: Column) -> Column:
    """The larger of two; missing if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def as_number(x: Column, zero_if_missing: bool = True) -> Column:
    value = known(x.cast("double"))
    return F.coalesce(value, F.lit(0.0)) if zero_if_missing else value


def is_numeric(text: Column) -> Column:
    return F.trim(text).try_cast("double").isNotNull()


def fresh_annual_report(report_serial: Column, date: Column) -> Column:
    """Whether a report date (spreadsheet serial number) is 31 December of the year before the row's date."""
    last = F.make_date(F.year(date) - 1, F.lit(12), F.lit(31))
    return is_true(report_serial == F.datediff(last, F.lit("1899-12-30").cast("date")))

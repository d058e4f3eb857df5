"""Dates: serial numbers, formats, weekdays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days from a MATLAB serial date to a spreadsheet's.
MATLAB_OFFSET = 693960

#: Format name -> pattern of a timestamp. Fixed values.
FORMATS = {
    "y-m-d": "yyyy-M-d",
    "y/m/d": "yyyy/M/d",
    "y-m-d h:m": "yyyy-M-d H:mm",
    "y/m/d h:m": "yyyy/M/d H:mm",
    "y-m-d h:m:s": "yyyy-M-d H:mm:ss",
    "y/m/d h:m:s": "yyyy/M/d H:mm:ss",
}


def excel_to_timestamp(serial: Column) -> Column:
    """Days since 1899-12-30, with a fraction of a day, in whole seconds."""
    seconds = F.round(serial.cast("double") * 86400).cast("long")
    return F.timestamp_seconds(seconds + F.unix_timestamp(F.lit("1899-12-30 00:00:00").cast("timestamp")))


def matlab_to_timestamp(serial: Column) -> Column:
    return excel_to_timestamp(serial.cast("double") - MATLAB_OFFSET)


def split_yyyymmdd(n: Column) -> dict[str, Column]:
    n = n.cast("long")
    return {"year": F.floor(n / 10000).cast("int"), "month": F.floor(F.pmod(n, F.lit(10000)) / 100).cast("int"), "day": F.pmod(n, F.lit(100)).cast("int")}


def guess_format(sample: Column) -> Column:
    """The format of a time written as text: a name of FORMATS, excel, matlab, yyyymmdd, or unknown."""
    number = F.trim(sample).try_cast("double")
    colons = F.char_length(sample) - F.char_length(F.replace(sample, F.lit(":"), F.lit("")))
    mark = F.when(F.contains(sample, F.lit("/")), "y/m/d").when(F.contains(sample, F.lit("-")), "y-m-d")
    clock = F.when(colons == 0, "").when(colons == 1, " h:m").when(colons == 2, " h:m:s")
    return (
        F.when(number.isNotNull() & (number > 0) & (number < 50000), "excel")
        .when(number.isNotNull() & (number >= 50000) & (number < 800000), "matlab")
        .when(number.isNotNull() & number.between(1e7, 3e7), "yyyymmdd")
        .when(number.isNull() & mark.isNotNull() & clock.isNotNull(), F.concat(mark, clock))
        .otherwise("unknown")
    )


def parse_time(text: Column, kind: Column, clock: Column | None = None) -> Column:
    """A timestamp from text of a given format; NULL if it doesn't parse. clock: a second column hhmmss for yyyymmdd."""
    number = F.trim(text).try_cast("double")
    p = split_yyyymmdd(number)
    day = F.try_to_timestamp(F.concat_ws("-", *[p[k].cast("string") for k in ("year", "month", "day")]), F.lit("yyyy-M-d"))
    if clock is not None:
        c = F.coalesce(clock.try_cast("long"), F.lit(0))
        day = F.timestamp_seconds(F.unix_timestamp(day) + F.floor(c / 10000) * 3600 + F.floor(F.pmod(c, F.lit(10000)) / 100) * 60 + F.pmod(c, F.lit(100)))
    out = F.when(kind == "excel", excel_to_timestamp(number)).when(kind == "matlab", matlab_to_timestamp(number)).when(kind == "yyyymmdd", day)
    for name, pattern in FORMATS.items():
        out = out.when(kind == name, F.try_to_timestamp(text, F.lit(pattern)))
    return out


def any_time(text: Column) -> Column:
    """A timestamp from any text in a format that guess_format knows."""
    return parse_time(text, guess_format(text))


def next_weekday(date: Column, weekday: int) -> Column:
    """The next date strictly later that is the weekday, 1 = Monday."""
    return F.next_day(date, ["MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN"][weekday - 1])


def week_of_month(date: Column) -> Column:
    """Weeks start on Monday; days before the year's first Monday are in week 0, as counted from the month's first day."""
    week = lambda d: F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    return (week(date) - week(F.trunc(date, "month")) + 1).cast("long")


def shift_start(time: Column, hour: int | None = None, minute: int | None = None, second: int | None = None, weekday: int | None = None) -> Column:
    """A start time with hour, minute and second set, moved forward to a weekday (1 = Monday; the same day counts)."""
    h = F.hour(time) if hour is None else F.lit(hour)
    m = F.minute(time) if minute is None else F.lit(minute)
    s = F.second(time) if second is None else F.lit(second)
    ahead = F.lit(0) if weekday is None else F.pmod(F.lit(weekday - 1) - F.weekday(time), F.lit(7))
    return F.timestamp_seconds(F.unix_timestamp(F.date_trunc("day", time)) + ahead * 86400 + h * 3600 + m * 60 + s)

"""Shifts, fills, states and rolling statistics of one asset's rows in date order.

Windows count rows, so that panels have to be dense (see panel.densify). ``i`` is the row's 0-based number. Functions of
columns look at a bounded number of rows; all of one query take the same window ``w``, so that Spark shuffles and sorts
once for them, best that of ordered.rolling, which cuts long series into blocks. Functions of frames carry what they
know from the first row on, from block to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyfold.functions.cells import is_true, ratio_change
from tallyfold.operators.ordered import BLOCK, State, by_number, largest, last, last_value, least, rolling, running, total


def by_asset(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*(keys or ("asset",))).orderBy(order)


def roll(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


# shifts, returns, fills


def ref(x: Column, n: int, w: WindowSpec, fill=None) -> Column:
    """The value n rows before (n < 0: after); fill stands beyond the edge only."""
    if n == 0:
        return x
    return F.lag(x, n, fill).over(w) if n > 0 else F.lead(x, -n, fill).over(w)


def reldiff(x: Column, w: WindowSpec) -> Column:
    """x over the row before, less 1; 0 where either is missing; infinite after a 0."""
    return F.coalesce(ratio_change(x, F.lag(x).over(w)), F.lit(0.0))


def diff(x: Column, w: WindowSpec) -> Column:
    """Change from the row before; the first row from 0; 0 where either is missing."""
    return F.coalesce(x - F.lag(x, 1, 0.0).over(w), F.lit(0.0))


def nav2ret(x: Column, i: Column, w: WindowSpec, first: float = 0.0) -> Column:
    """Returns of a net asset value; the first row gets first, missing stays missing."""
    return F.when(i == 0, F.lit(first)).otherwise(ratio_change(x, F.lag(x).over(w)))


def ffill(df: DataFrame, columns: dict[str, Column], by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """Adds columns by name: the last value that is not missing."""
    return _run(df, {n: last_value(x) for n, x in columns.items()}, by, i, block)


def _run(df: DataFrame, states: dict[str, State], by: tuple[str, ...], i: str, block: int, before: bool = False) -> DataFrame:
    return running(by_number(df, by, i, block), states, before).drop("_part")


def pause(df: DataFrame, x: Column, paused: Column, name: str = "held", by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """Adds x, paused rows keeping the row before's output; 0 before the first row that is not paused."""
    d = _run(df, {name: last(x, ~is_true(paused))}, by, i, block)
    return d.withColumn(name, F.when(F.col(name).isNull(), F.lit(0.0)).otherwise(F.col(name)["v"]))


def trade_rows(i: Column, every: int, start: int = 1) -> Column:
    """Rows start - 1, start - 1 + every, ...; start is at most every."""
    first = min(start, every) - 1
    return (i >= first) & (F.pmod(i - first, F.lit(every)) == 0)


def held(df: DataFrame, x: Column, takes: dict[str, Column], by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """Adds columns by name: x, missing too, of the last row that the name's condition takes; row 0 always counts."""
    d = _run(df, {n: last(x, is_true(t) | (F.col(i) == 0)) for n, t in takes.items()}, by, i, block)
    return d.withColumns({n: F.col(n)["v"] for n in takes})


def reduce_freq(df: DataFrame, x: Column, every: int, start: int = 1, trade: Column | None = None, name: str = "held", by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """Adds x held from the last trade row on."""
    if every == 1 and trade is None:
        return df.withColumn(name, x)
    return held(df, x, {name: trade_rows(F.col(i), every, start) if trade is None else trade}, by, i, block)


def reduce_freq_older(df: DataFrame, x: Column, every: int, start: int = 1, name: str = "held", by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """The older rule: a period of every + 1 rows."""
    return held(df, x, {name: F.pmod(F.col(i) + start - 1, F.lit(every + 1)) == 0}, by, i, block)


def reduce_freq_staggered(df: DataFrame, x: Column, every: int, parts: int, name: str = "held", by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """Adds the mean of several copies of reduce_freq whose first trade rows are spread over the period."""
    parts = min(parts, every)
    if every == 1:
        return df.withColumn(name, x)
    takes = {f"_copy{k}": trade_rows(F.col(i), every, int(1 + round(k * (every - 1) / parts))) for k in range(parts)}
    d = held(df, x, takes, by, i, block)
    return d.withColumn(name, sum((F.col(c) for c in list(takes)[1:]), F.col("_copy0")) / parts).drop(*takes)


def shift_return(ret: Column, time: Column, annual: float, w: WindowSpec) -> Column:
    """Add an annual amount by the days since the row before."""
    return ret + annual * F.coalesce(F.datediff(time, F.lag(time).over(w)), F.lit(0)) / 365.25


def cross(a: Column, b: Column, w: WindowSpec) -> Column:
    """Whether a was below b on the row before and no longer is."""
    return is_true(F.lag(a < b).over(w)) & is_true(a >= b)


def mark_neighbors(flag: Column, k: int, w: WindowSpec) -> Column:
    return F.max(is_true(flag)).over(w.rowsBetween(-k, k))


# states


def bars_since(df: DataFrame, b: Column, name: str = "bars", by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """Adds the rows since the last true before this row; i where there is none."""
    d = _run(df, {"_last": largest(F.when(is_true(b), F.col(i)))}, by, i, block, before=True)
    return d.withColumn(name, F.coalesce(F.col(i) - 1 - F.col("_last"), F.col(i)).cast("long")).drop("_last")


def bars_held(df: DataFrame, x: Column, name: str = "bars", by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """Adds 1, 2, 3, ... from the first valid row on; 0 before."""
    d = _run(df, {"_first": least(F.when(x.isNotNull(), F.col(i)))}, by, i, block)
    return d.withColumn(name, F.coalesce(F.col(i) - F.col("_first") + 1, F.lit(0)).cast("long")).drop("_first")


def with_count_since(df: DataFrame, x: Column, y: Column, name: str = "count_since", by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """Adds occurrences of x in as many rows as bars_since(y) says; where that is 0, in the whole history."""
    d = _run(df, {"_s": total(is_true(x).cast("long"))}, by, i, block)
    d = bars_since(d, y, "_n", by, i, block)
    d = _run(d, {"_held": last_value(F.when(F.col("_n") == 0, F.col("_s")))}, by, i, block)
    return d.withColumn(name, F.when(F.col("_n") == 0, F.col("_s")).otherwise(F.col("_s") - F.col("_held"))).drop("_s", "_n", "_held")


def with_age(df: DataFrame, member: Column, name: str = "age", by: tuple[str, ...] = ("asset",), i: str = "i", block: int = BLOCK) -> DataFrame:
    """Adds k after k rows inside, -k after k rows outside, 0 on a row of entry or exit and on the first row."""
    d = rolling(df.withColumn("_m", is_true(member)), lambda w: {"_turn": F.coalesce(F.col("_m") != F.lag("_m").over(w), F.lit(True))}, 1, by=by, i=i, rows=block)
    d = _run(d, {"_from": largest(F.when(F.col("_turn"), F.col(i)))}, by, i, block)
    return d.withColumn(name, ((F.col(i) - F.col("_from")) * F.when(F.col("_m"), 1).otherwise(-1)).cast("long")).drop("_m", "_turn", "_from")


def ref_dynamic(df: DataFrame, x: str, n: str, keys: tuple[str, ...] = ("asset",), i: str = "i", fill=None, name: str = "ref") -> DataFrame:
    """Adds the value n rows up, n being a column; fill where there is no such row. Both sides are dealt by asset and row."""
    source = df.select(*keys, F.col(i).alias("_i"), F.struct(F.col(x).alias("v")).alias("_v"))
    d = df.withColumn("_i", F.col(i) - F.col(n)).join(source, [*keys, "_i"], "left")
    return d.withColumn(name, F.when(F.col("_v").isNull(), F.lit(fill)).otherwise(F.col("_v.v"))).drop("_i", "_v")


def with_dynamic_sum(df: DataFrame, x: Column, width: str, by: tuple[str, ...] = ("asset",), i: str = "i", name: str = "sum", block: int = BLOCK) -> DataFrame:
    """Adds the sum over the last width rows, width being a column: 0 means from the start; NULL if there are too few rows, or width is negative."""
    d = _run(df, {"_s": total(F.coalesce(x, F.lit(0.0)))}, by, i, block)
    before = d.select(*by, F.col(i).alias("_i"), F.col("_s").alias("_b"))
    d = d.withColumn("_i", F.when(F.col(width) > 0, F.col(i) - F.col(width))).join(before, [*by, "_i"], "left")
    value = F.when(F.col(width) == 0, F.col("_s")).when((F.col(width) > 0) & (F.col("_i") == -1), F.col("_s")).when(F.col("_i") >= 0, F.col("_s") - F.col("_b"))
    return d.withColumn(name, value).drop("_s", "_i", "_b")


# rolling statistics


def _enough(value: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(frame) >= least, value)


def ma(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    return _enough(F.avg(x).over(roll(w, n)), x, roll(w, n), least or n)


def min_roll(x: Column, n: int, w: WindowSpec, least: int = 1) -> Column:
    return _enough(F.min(x).over(roll(w, n)), x, roll(w, n), least)


def max_roll(x: Column, n: int, w: WindowSpec, least: int = 1) -> Column:
    return _enough(F.max(x).over(roll(w, n)), x, roll(w, n), least)


def sum_roll(x: Column, n: int, w: WindowSpec, least: int | None = None) -> Column:
    """Sum of the last n rows' values, once least (by default n) of them are there."""
    return _enough(F.sum(x).over(roll(w, n)), x, roll(w, n), least or n)


def all_roll(b: Column, n: int, w: WindowSpec) -> Column:
    return is_true(F.sum(is_true(b).cast("int")).over(roll(w, n)) == n)


def std_roll(x: Column, n: int, w: WindowSpec, floor: float | None = None, least: int | None = None) -> Column:
    std = _enough(F.stddev_samp(x).over(roll(w, n)), x, roll(w, n), least or n)
    return std if floor is None else F.when(std.isNotNull(), F.greatest(std, F.lit(floor)))


def skew_roll(x: Column, n: int, w: WindowSpec) -> Column:
    """Skewness with bias correction; 0 for equal values."""
    k = F.count(x).over(roll(w, n))
    raw = F.coalesce(F.nullif(F.skewness(x).over(roll(w, n)), F.lit(float("nan"))), F.lit(0.0))
    return F.when((k >= n) & (k >= 3), raw * F.sqrt(k * (k - 1)) / (k - 2))


def kurt_roll(x: Column, n: int, w: WindowSpec) -> Column:
    """Excess kurtosis with bias correction; -3 for equal values."""
    k = F.count(x).over(roll(w, n))
    raw = F.nullif(F.kurtosis(x).over(roll(w, n)), F.lit(float("nan")))
    return F.when((k >= n) & (k >= 4), F.coalesce((k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * raw + 6), F.lit(-3.0)))


def z_roll(x: Column, n: int, w: WindowSpec) -> Column:
    std = std_roll(x, n, w)
    return (x - ma(x, n, w)) / F.when(std != 0, std)


def slope_roll(y: Column, x: Column, n: int, w: WindowSpec) -> Column:
    """Rolling cov(x, y) / var(x), where all rows of the window have both."""
    both = x.isNotNull() & y.isNotNull()
    full = F.sum(both.cast("int")).over(roll(w, n)) == n
    return F.when(full, F.regr_slope(y, x).over(roll(w, n)))


def rows_since_max(x: Column, i: Column, n: int, w: WindowSpec) -> Column:
    """Rows since the largest value in the window, the most recent of equals."""
    best = F.max(F.when(x.isNotNull(), F.struct(x.alias("v"), i.alias("i")))).over(roll(w, n))
    return (i - best["i"]).cast("long")


def rows_since_min(x: Column, i: Column, n: int, w: WindowSpec) -> Column:
    return rows_since_max(-x, i, n, w)


def count_true(b: Column, n: int, w: WindowSpec) -> Column:
    """Trues in a full window."""
    return F.when(F.count(F.lit(1)).over(roll(w, n)) == n, F.sum(is_true(b).cast("long")).over(roll(w, n)))

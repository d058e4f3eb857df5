"""Cross-sections: one date's values over all assets. Ties are broken by asset."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.cells import is_true
from tallyfold.operators.panel import calendar
from tallyfold.operators.ordered import BLOCK, ROWS, by_splitters, join_null_safe, number, running
from tallyfold.operators.selection import VALUES, percentiles
from tallyfold.operators.triangles import named, triangles
from tallyfold.operators.windows import reduce_freq
from tallyfold.sources.storage import cut

#: Stands for a null date.
NO_DATE = -(1 << 31)


def placed(df: DataFrame, x: Column, by: tuple[str, ...] = ("date",), tie: str = "asset", rows: int = ROWS) -> DataFrame:
    """Adds _place, the 0-based rank from the smallest value, missing last, ties by asset; and _valid, the group's number of valid values.

    A date (or other group) with more than so many rows is cut at splitters: each task ranks a range of its values, and
    the numbers of rows in the ranges before are added.
    """
    parts = by_splitters(df.withColumn("_x", x), by, [F.col("_x").isNull(), F.col("_x"), F.col(tie)], rows)
    if not parts.split:
        w = Window.partitionBy(*by)
        place = F.row_number().over(w.orderBy(F.col("_x").asc_nulls_last(), tie)) - 1
        return parts.df.select(*df.columns, place.cast("long").alias("_place"), F.count("_x").over(w).alias("_valid"))
    valid = cut(parts.df.groupBy(*by).agg(F.count("_x").alias("_valid")))
    ranked = running(parts, {"_place": number(F.lit(True))}, before=True)
    return join_null_safe(ranked, valid, by).drop("_x", "_part")


def with_rank(df: DataFrame, x: Column, name: str = "place", rows: int = ROWS) -> DataFrame:
    """Adds the 0-based rank from the date's smallest value, missing last."""
    return placed(df, x, rows=rows).withColumnRenamed("_place", name).drop("_valid")


def with_pct(df: DataFrame, x: Column, name: str = "pct", older: bool = False, by: tuple[str, ...] = ("date",), rows: int = ROWS) -> DataFrame:
    """Adds the rank over the number of valid values less 1; missing for a missing value, and where it alone is valid. The older form divides by the number."""
    d = placed(df.withColumn("_y", x), F.col("_y"), by, rows=rows)
    n = F.col("_valid") if older else F.nullif(F.col("_valid") - 1, F.lit(0))
    return d.withColumn(name, F.when(F.col("_y").isNotNull(), F.col("_place") / n)).drop("_y", "_place", "_valid")


def with_top_n(df: DataFrame, score: Column, subset: Column, n: int, name: str = "top", rows: int = ROWS) -> DataFrame:
    """Adds whether a cell is among the n smallest scores of the date's subset; missing scores come last."""
    d = placed(df.withColumn("_chosen", is_true(subset)), score, ("date", "_chosen"), rows=rows)
    return d.withColumn(name, F.col("_chosen") & (F.col("_place") < n)).drop("_chosen", "_place", "_valid")


def largest(df: DataFrame, x: str, n: int, ties: tuple[str, ...] = ("asset", "date")) -> DataFrame:
    return df.filter(F.col(x).isNotNull()).orderBy(F.desc(x), *ties).limit(n)


def with_stats(df: DataFrame, *stats: Column) -> DataFrame:
    """Adds aggregates over each date's assets.

    Each task sums up its own rows of a date before they are shuffled, and a row for each date is joined back: unlike a
    window, no task gets all assets of a date. Spark plans df twice for that; cut() it first where it is dear.
    """
    by_date = df.groupBy(F.col("date").alias("_date")).agg(*stats)
    return df.join(by_date, F.col("date").eqNullSafe(F.col("_date")), "left").drop("_date")


def scale_row(df: DataFrame, x: Column, name: str = "scaled") -> DataFrame:
    """To [0, 1] by the date's range; missing where that is 0."""
    d = with_stats(df, F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    return d.withColumn(name, (x - F.col("_lo")) / F.when(F.col("_hi") != F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


def scale_all(df: DataFrame, x: str, name: str = "scaled") -> DataFrame:
    """To [0, 1] by the range of the whole column; 0 if it is constant."""
    ends = df.agg(F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    value = F.when(F.col("_hi") == F.col("_lo"), F.col(x) * 0).otherwise((F.col(x) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    return df.crossJoin(F.broadcast(ends)).withColumn(name, value).drop("_lo", "_hi")


def cuts(df: DataFrame, size: str = "market_cap", measures: tuple[str, ...] = ("pb_ratio", "roe", "asset_growth"), digits: int = 12, rows: int = VALUES) -> DataFrame:
    """Adds size_cut (1 from the median on, else -1) and <measure>_cut (1 from the 70th percentile on, -1 up to the 30th, which wins, else 0).

    A date's percentiles, one row for each date, are joined back by broadcast when Spark finds them small.
    """
    found = percentiles(df, {size: [0.5], **{m: [0.3, 0.7] for m in measures}}, rows=rows)
    stats = found.select(F.col("date").alias("_date"), *[F.transform(c, lambda p: F.round(p, digits)).alias(f"_{c}") for c in (size, *measures)])
    d = df.join(stats, F.col("date") == F.col("_date"))
    middle = F.get(f"_{size}", F.lit(0))
    out = [F.when(F.col(size) >= middle, 1).when(F.col(size) < middle, -1).cast("long").alias("size_cut")]
    for m in measures:
        x, p = F.col(m), F.col(f"_{m}")
        out.append(F.when(x.isNull(), None).when(x <= p[0], -1).when(x >= p[1], 1).otherwise(0).cast("long").alias(f"{m}_cut"))
    return d.select(*df.columns, *out)


def between_pct(df: DataFrame, x: Column, valid: Column, lo: float, hi: float, name: str = "chosen", rows: int = ROWS) -> DataFrame:
    """Adds whether a cell's percentile among the date's valid cells is in [lo, hi]."""
    d = with_pct(df, F.when(is_true(valid), x), "_pct", rows=rows)
    return d.withColumn(name, is_true(F.col("_pct").between(lo, hi))).drop("_pct")


def rank_select(df: DataFrame, x: Column, regions: list[Column], lo: float, hi: float, also: Column | None = None, name: str = "chosen", rows: int = ROWS) -> DataFrame:
    """Adds in how many of the regions, which may overlap, a cell's percentile among the region's valid cells is in [lo, hi].

    A second region, if given, cuts down each of them. df has one row for each asset and date.
    """
    inside = [is_true(g) if also is None else is_true(g) & is_true(also) for g in regions]
    member = F.array_compact(F.array(*[F.when(g, k) for k, g in enumerate(inside)]))
    cells = df.select("asset", "date", x.alias("_y"), F.explode(member).alias("_region")).filter("_y is not null")
    hits = with_pct(cells, F.col("_y"), "_at", by=("date", "_region"), rows=rows).filter(F.col("_at").between(lo, hi))
    return df.join(hits.groupBy("asset", "date").agg(F.count(F.lit(1)).cast("double").alias("_n")), ["asset", "date"], "left").withColumn(name, F.coalesce("_n", F.lit(0.0))).drop("_n")


def select_in_regions(df: DataFrame, x: str, region: str, lo: float, hi: float, name: str = "chosen", rows: int = ROWS) -> DataFrame:
    """As between_pct, each region of the date by itself; rows without a region are never selected."""
    d = with_pct(df, F.col(x), "_pct", by=("date", region), rows=rows)
    return d.withColumn(name, is_true(F.col(region).isNotNull() & F.col("_pct").between(lo, hi))).drop("_pct")


def positions(df: DataFrame, factor: str, excluded: Column, lo: float, hi: float, every: int, short: bool, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Adds pos: 1 for percentiles in [lo, hi], -1 for [1 - hi, 1 - lo] if short, held between trade rows, 0 for excluded cells.

    One shuffle by date for the ranks, one by asset for the holding.
    """
    d = with_pct(df.withColumn("_out", is_true(excluded)), F.when(~is_true(excluded), F.col(factor)), "_pct", rows=rows)
    p = F.col("_pct")
    low = p.between(round(1 - hi, 12), round(1 - lo, 12))  # 1 - 0.8 is 0.2
    raw = F.when(p.between(lo, hi), 1.0).otherwise(0.0) - (F.when(low, 1.0).otherwise(0.0) if short else F.lit(0.0))
    d = reduce_freq(d.withColumn("_raw", raw), F.col("_raw"), every, name="_held", block=block)
    return d.withColumn("pos", F.when(F.col("_out"), 0.0).otherwise(F.col("_held"))).drop("_pct", "_raw", "_out", "_held")


def equal_weights(df: DataFrame, x: Column, name: str = "weight") -> DataFrame:
    return with_stats(df, F.count(x).alias("_n")).withColumn(name, F.when(x.isNotNull(), 1 / F.col("_n")).otherwise(0.0)).drop("_n")


def add_alpha(df: DataFrame, base: Column, alpha: Column, name: str = "weight") -> DataFrame:
    """base plus the largest multiple of alpha that leaves no weight negative; missing without a negative alpha."""
    k = -F.max(F.when(alpha < 0, base / F.when(alpha < 0, alpha)))
    return with_stats(df, k.alias("_k")).withColumn(name, base + F.col("_k") * alpha).drop("_k")


def group_means(df: DataFrame, x: str, group: str) -> DataFrame:
    """(date, group, mean) for all dates and groups but 0; a date without the group has no mean."""
    known = df.filter(F.col(group).isNotNull() & (F.col(group) != 0))
    grid = known.select(group).distinct().crossJoin(F.broadcast(calendar(df))).select(group, F.explode("_dates").alias("date"))
    return grid.join(known.groupBy("date", group).agg(F.avg(x).alias("mean")), ["date", group], "left")


def residual_one(df: DataFrame, y: Column, x: Column, name: str = "residual") -> DataFrame:
    """Residual on one basis, by date, without an intercept, over rows that have both."""
    both = y.isNotNull() & x.isNotNull()
    beta = F.sum(F.when(both, x * y)) / F.nullif(F.sum(F.when(both, x * x)), F.lit(0.0))
    return with_stats(df, beta.alias("_beta")).withColumn(name, F.when(both, y - F.col("_beta") * x)).drop("_beta")


def residual_two(df: DataFrame, y: Column, a: Column, b: Column, name: str = "residual") -> DataFrame:
    """Residual on two bases, by date, without an intercept, from sums over the date; missing where they are collinear."""
    ok = y.isNotNull() & a.isNotNull() & b.isNotNull()
    s = lambda u, v: F.sum(F.when(ok, u * v))
    d = with_stats(df, s(a, a).alias("_aa"), s(b, b).alias("_bb"), s(a, b).alias("_ab"), s(a, y).alias("_ay"), s(b, y).alias("_by"))
    c = F.col
    det = F.nullif(c("_aa") * c("_bb") - c("_ab") * c("_ab"), F.lit(0.0))
    first = (c("_ay") * c("_bb") - c("_by") * c("_ab")) / det
    second = (c("_by") * c("_aa") - c("_ay") * c("_ab")) / det
    return d.withColumn(name, F.when(ok, y - first * a - second * b)).drop("_aa", "_bb", "_ab", "_ay", "_by")


def _valid(c: str) -> Column:
    return F.nullif(F.col(c).cast("double"), F.lit(float("nan")))


def coefficients(df: DataFrame, y: str, bases: list[str]) -> DataFrame:
    """(date, coefficients): least squares of y on the bases without an intercept, by date, over rows that have all.

    Each task reduces a date's rows to a triangle of as many rows as columns (QR); a date's triangles meet and are
    solved. Collinear bases get the solution of least norm. A date without complete rows has no row.
    """
    k = len(bases)
    x = named(k + 1)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.linalg.qr(pdf[x].to_numpy(float), mode="r")
        # The cut-off for collinear columns is that of the whole problem.
        c = np.linalg.lstsq(m[:, :k], m[:, k], rcond=np.finfo(float).eps * max(int(pdf["n"].sum()), k))[0]
        return pd.DataFrame({"_d": pdf["_d"].iloc[:1], "coefficients": [c.tolist()]})

    small = triangles(df.select(F.coalesce(F.unix_date("date"), F.lit(NO_DATE)).alias("_d"), *bases, y), ["_d"], [*bases, y])
    solved = small.groupBy("_d").applyInPandas(solve, "_d int, coefficients array<double>")
    return solved.select(F.when(F.col("_d") != NO_DATE, F.date_from_unix_date("_d")).alias("date"), "coefficients")


def residual_many(df: DataFrame, y: str, bases: list[str]) -> DataFrame:
    """(asset, date, residual) on any number of bases: one least-squares problem for each date, whose coefficients, a row for each date, are joined back."""
    solved = F.broadcast(coefficients(df, y, bases).withColumnRenamed("date", "_date"))
    fit = F.lit(0.0)
    for j, c in enumerate(bases):
        fit = fit + _valid(c) * F.get("coefficients", F.lit(j))
    return df.join(solved, F.col("date").eqNullSafe(F.col("_date")), "left").select("asset", "date", (_valid(y) - fit).alias("residual"))


def first_coefficient(df: DataFrame, y: str, x: str | list[str]) -> DataFrame:
    """(date, beta): of least squares of y on x, or on several columns, without an intercept, the coefficient of the first; missing if it can't be solved."""
    if not isinstance(x, str):
        solved = coefficients(df, y, x).select("date", F.get("coefficients", F.lit(0)).alias("beta"))
        return df.select("date").distinct().join(solved.withColumnRenamed("date", "_date"), F.col("date").eqNullSafe(F.col("_date")), "left").select("date", "beta")
    both = F.col(y).isNotNull() & F.col(x).isNotNull()
    xy, xx = F.sum(F.when(both, F.col(x) * F.col(y))), F.sum(F.when(both, F.col(x) * F.col(x)))
    return df.groupBy("date").agg((xy / F.nullif(xx, F.lit(0.0))).alias("beta"))


def first_extreme(df: DataFrame, x: str, i: str, by: str, largest: bool = True) -> DataFrame:
    """(by, place) of the first largest or smallest value."""
    value = -F.col(x) if largest else F.col(x)
    return df.filter(F.col(x).isNotNull()).groupBy(by).agg(F.min_by(F.col(i), F.struct(value, F.col(i))).alias("place"))

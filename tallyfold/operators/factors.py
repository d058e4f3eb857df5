"""Style factors from a stock panel, and regressions of fund returns on them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators import linalg
from tallyfold.operators.ordered import join_null_safe
from tallyfold.operators.triangles import named, triangles
from tallyfold.operators.windows import ref, reldiff, so_far
from tallyfold.sources.storage import cut, ship

#: Measure -> letters of its upper, middle and lower bucket.
LETTERS = {"pb_ratio": ("H", "M", "L"), "roe": ("R", "N_roe", "W"), "asset_growth": ("A", "N_growth", "C")}


def _weighted(ret: Column, cap: Column, chosen: Column | None = None) -> Column:
    """Cap-weighted mean return; 0 for an empty bucket. Caps of cells without a return count as well."""
    pick = (lambda x: x) if chosen is None else (lambda x: F.when(chosen, x))
    return F.coalesce(F.sum(pick(ret * cap)) / F.nullif(F.sum(pick(cap)), F.lit(0.0)), F.lit(0.0))


def market_return(df: DataFrame, ret: str = "ret", cap: str = "market_cap") -> DataFrame:
    return df.groupBy("date").agg(_weighted(F.col(ret), F.col(cap)).alias("rm"))


def buckets(df: DataFrame, ret: str = "ret", cap: str = "market_cap") -> DataFrame:
    """One row for each date: rm and the returns of all 18 buckets (B big, S small, then the letter), in one aggregation."""
    cells = [_weighted(F.col(ret), F.col(cap)).alias("rm")]
    for m, letters in LETTERS.items():
        for direction, letter in zip((1, 0, -1), letters, strict=True):
            for side, size in (("B", 1), ("S", -1)):
                cells.append(_weighted(F.col(ret), F.col(cap), (F.col(f"{m}_cut") == direction) & (F.col("size_cut") == size)).alias(f"{side}{letter}"))
    return df.groupBy("date").agg(*cells)


def five_factors(b: DataFrame) -> DataFrame:
    """(date, rm, smb, hml, rmw, cma). The neutral buckets are the mean of those by return on equity and by growth, for all three size factors."""
    c = lambda side, letter: F.col(f"{side}{letter}")
    n = lambda side: (c(side, "N_roe") + c(side, "N_growth")) / 2
    size = lambda hi, lo: (c("S", hi) + n("S") + c("S", lo)) / 3 - (c("B", hi) + n("B") + c("B", lo)) / 3
    spread = lambda hi, lo: (c("S", hi) + c("B", hi)) / 2 - (c("S", lo) + c("B", lo)) / 2
    return b.select(
        "date", "rm", ((size("H", "L") + size("R", "W") + size("C", "A")) / 3).alias("smb"), spread("H", "L").alias("hml"), spread("R", "W").alias("rmw"), spread("C", "A").alias("cma")
    )


def event_factor(df: DataFrame, ret: str = "ret", flag: str = "flag") -> DataFrame:
    """(step, date, value): mean return of flag 1 less that of flag -1, compounded from 1; a date without both holds. Step 0 is the start."""
    each = df.groupBy("date").agg((F.avg(F.when(F.col(flag) == 1, F.col(ret))) - F.avg(F.when(F.col(flag) == -1, F.col(ret)))).alias("d"))
    w = Window.orderBy("date")  # one row for each date
    run = each.select(F.row_number().over(w).cast("long").alias("step"), "date", F.product(1 + F.coalesce("d", F.lit(0.0))).over(so_far(w)).alias("value"))
    start = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("step"), F.lit(None).cast("date").alias("date"), F.lit(1.0).alias("value"))
    return run.unionByName(start)


def quarterly(date: str = "date") -> list[Column]:
    return [F.year(date).cast("long").alias("year"), F.quarter(date).cast("long").alias("quarter")]


def period_counts(df: DataFrame, monthly: bool = False) -> DataFrame:
    part = F.month("date").cast("long").alias("month") if monthly else F.quarter("date").cast("long").alias("quarter")
    return df.groupBy(F.year("date").cast("long").alias("year"), part).agg(F.count(F.lit(1)).alias("n"))


def factor_means(f: DataFrame) -> DataFrame:
    """(period, smb, hml, rmw, cma): means by quarter; the period is the month's end of the quarter's first date."""
    cols = ("smb", "hml", "rmw", "cma")
    g = f.groupBy(*quarterly()).agg(F.last_day(F.min("date")).alias("period"), *[F.avg(c).alias(c) for c in cols])
    return g.select("period", *cols)


TERMS = ("const", "rm_rf", "smb", "hml", "rmw", "cma")


def attribution(returns: DataFrame, factors: DataFrame, risk_free: DataFrame) -> DataFrame:
    """(deal, period, term, beta, t_value, p_value): a fund's returns (deal, date, ret) on the factors, by quarter, with a constant.

    Factors and risk-free rates are a row for each date. A problem that can't be solved gives betas of 0, and no t- and
    p-values. Each task reduces its rows of a quarter to a triangle, which keeps the residuals' sum of squares as well;
    the triangles of a quarter are what meets.
    """
    keys, terms = ["deal", "year", "quarter"], list(TERMS[1:])
    f = factors.join(risk_free, "date", "left").select("date", (F.col("rm") - F.coalesce("rf", F.lit(0.0))).alias("rm_rf"), "smb", "hml", "rmw", "cma")
    rows = cut(returns.join(f, "date").select("deal", "date", *quarterly(), F.lit(1.0).alias("const"), *terms, "ret"))
    x = named(len(TERMS) + 1)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.linalg.qr(pdf[x].to_numpy(float), mode="r")
        found = linalg.solved(m[:, :-1], m[:, -1], int(pdf["n"].sum()))
        values = [[None if np.isnan(v) else float(v) for v in c] for c in found]
        return pdf[keys].iloc[:1].assign(beta=[values[0]], t_value=[values[1]], p_value=[values[2]])

    schema = f"deal {returns.schema['deal'].dataType.simpleString()}, year long, quarter long, beta array<double>, t_value array<double>, p_value array<double>"
    fits = triangles(rows, keys, [*TERMS, "ret"]).groupBy(*keys).applyInPandas(fit, schema)
    periods = rows.groupBy(*keys).agg(F.last_day(F.min("date")).alias("period"))
    d = join_null_safe(periods, fits, tuple(keys), counted=False)
    each = d.select("deal", "period", "beta", "t_value", "p_value", F.posexplode(F.array(*[F.lit(t) for t in TERMS])).alias("k", "term"))
    at = lambda c: F.get(c, F.col("k"))
    return each.select("deal", "period", "term", F.coalesce(at("beta"), F.lit(0.0)).alias("beta"), at("t_value").alias("t_value"), at("p_value").alias("p_value"))


def portfolio_nav(df: DataFrame, w, pos: str = "pos", price: str = "close") -> DataFrame:
    """(date, nav): compounded sum over assets of the return times the position of the row before."""
    parts = df.select("date", (reldiff(F.col(price), w) * ref(F.col(pos), 1, w)).alias("r"))
    total = parts.groupBy("date").agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("r"))
    return total.select("date", F.product(1 + F.col("r")).over(so_far(Window.orderBy("date"))).alias("nav"))


def tabulate(df: DataFrame, x: str) -> DataFrame:
    return df.groupBy(x).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), x)


def first_seen(df: DataFrame, x: str, order: str) -> DataFrame:
    """Distinct values with the place where each is seen first."""
    return df.groupBy(x).agg(F.min(order).alias("first_at")).orderBy("first_at")


def duplicate_dates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def segment_fit(df: DataFrame, x: str, y: str, n: int = 5) -> DataFrame:
    """(segment, lo, hi, mean) of n segments of equal width, (lo, hi], the first with its minimum."""
    ends = df.agg(F.min(x).alias("a"), F.max(x).alias("b")).select("a", "b", ((F.col("b") - F.col("a")) / n).alias("width"))
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).crossJoin(F.broadcast(ends))
    d = d.withColumn("segment", _segment(F.col(x), n))
    return d.groupBy("segment", (F.col("a") + F.col("segment") * F.col("width")).alias("lo"), (F.col("a") + (F.col("segment") + 1) * F.col("width")).alias("hi")).agg(F.avg(y).alias("mean"))


def _segment(x: Column, n: int) -> Column:
    inside = F.ceil((x - F.col("a")) / F.nullif(F.col("width"), F.lit(0.0))) - 1
    return F.greatest(F.least(F.coalesce(inside, F.lit(0)), F.lit(n - 1)), F.lit(0)).cast("long")


def segment_predict(df: DataFrame, fitted: DataFrame, x: str, n: int = 5) -> DataFrame:
    """Adds predicted: the mean of x's segment; missing outside all segments. fitted has at most n rows."""
    ends = fitted.agg(F.min(F.col("lo") - F.col("segment") * (F.col("hi") - F.col("lo"))).alias("a"), F.max(F.col("hi") - F.col("lo")).alias("width"))
    d = df.crossJoin(F.broadcast(ends)).withColumn("_in", F.col(x).between(F.col("a"), F.col("a") + n * F.col("width") * (1 + 1e-12)))
    d = d.withColumn("segment", F.when(F.col("_in"), _segment(F.col(x), n)))
    return d.join(F.broadcast(fitted.select("segment", F.col("mean").alias("predicted"))), "segment", "left").drop("a", "width", "_in", "segment")


def poly_fit(df: DataFrame, x: str, y: str, by: str, degree: int = 3) -> DataFrame:
    """(by, c0, c1, ...): polynomial regression for each group over complete rows.

    Power sums are aggregated by Spark, so that a group of any size costs one partial aggregation; the small systems
    are solved in batches. x is centred and scaled by the group's mean and spread first.
    """
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(by, F.col(x).alias("x"), F.col(y).alias("y"))
    stat = ok.groupBy(by).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = ok.join(stat, by).select(by, "m", "s", "y", ((F.col("x") - F.col("m")) / F.nullif(F.col("s"), F.lit(0.0))).alias("z"))
    sums = [F.sum(F.pow("z", F.lit(k))).alias(f"p{k}") for k in range(2 * degree + 1)] + [F.sum(F.pow("z", F.lit(k)) * F.col("y")).alias(f"q{k}") for k in range(degree + 1)]
    rows = z.groupBy(by, "m", "s").agg(*sums)

    def solve(batches):
        for b in batches:
            power, moment = b[[f"p{k}" for k in range(2 * degree + 1)]].to_numpy(float), b[[f"q{k}" for k in range(degree + 1)]].to_numpy(float)
            a = power[:, np.add.outer(np.arange(degree + 1), np.arange(degree + 1))]
            sound = np.isfinite(a).all(axis=(1, 2)) & (np.linalg.matrix_rank(np.where(np.isfinite(a), a, 0)) == degree + 1)
            c = np.full((len(b), degree + 1), np.nan)
            c[sound] = np.linalg.solve(a[sound], moment[sound][:, :, None])[:, :, 0]
            # From powers of (x - m) / s to powers of x, by the binomial rule.
            m, s = b["m"].to_numpy(float), b["s"].to_numpy(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                out = [sum(c[:, j] * math.comb(j, k) * (-m) ** (j - k) / s**j for j in range(k, degree + 1)) for k in range(degree + 1)]
            yield pd.concat([b[[by]].reset_index(drop=True), pd.DataFrame(np.array(out).T.reshape(-1, degree + 1), columns=[f"c{k}" for k in range(degree + 1)])], axis=1)

    ship(df.sparkSession)
    kind = df.schema[by].dataType.simpleString()
    return rows.mapInPandas(solve, f"{by} {kind}, " + ", ".join(f"c{k} double" for k in range(degree + 1)))


def poly_predict(df: DataFrame, fitted: DataFrame, x: str, by: str, degree: int = 3) -> DataFrame:
    value = F.lit(0.0)
    for k in range(degree, -1, -1):
        value = value * F.col(x) + F.col(f"c{k}")
    return df.join(fitted, by, "left").withColumn("predicted", value).drop(*[f"c{k}" for k in range(degree + 1)])


def integer_shares(df: DataFrame, weight: str, pos: str, by: str, total: Column) -> DataFrame:
    """Adds share: total times weight, rounded half to even; a surplus goes to the first largest weight, an excess is taken from the smallest weights first."""
    w = Window.partitionBy(by)
    up = Window.partitionBy(by).orderBy(weight, pos)
    d = df.withColumn("_raw", F.bround(total * F.col(weight), 0).cast("long"))
    d = d.withColumn("_gap", total - F.sum("_raw").over(w))
    before = F.coalesce(F.sum("_raw").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(weight), pos)) == 1
    taken = F.greatest(F.lit(0), F.least(F.col("_raw"), -F.col("_gap") - before))
    share = F.when(F.col("_gap") > 0, F.col("_raw") + F.when(top, F.col("_gap")).otherwise(0)).otherwise(F.col("_raw") - taken)
    return d.withColumn("share", share.cast("long")).drop("_raw", "_gap")

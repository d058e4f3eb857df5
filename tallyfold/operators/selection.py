"""Exact percentiles of groups of any size.

The value of a wanted rank is found by rounds of histograms: the values between two bounds are counted in bins, the bin
with the rank gives narrower bounds, until they meet. All groups, columns and ranks take part in the same rounds; a
round's state is a row for each of them, and a count for each bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.ordered import join_null_safe, large_groups
from tallyfold.sources.storage import cut

#: Rows of a group whose distinct values meet in one task.
VALUES = 100_000
#: Bins of finite values between two bounds.
BINS = 4096
#: Logarithms of the least and the largest positive number, rounded away from each other.
LEAST_LOG, LARGEST_LOG = -745.0, 710.0


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """0 for minus infinity, 1 to BINS for finite values from lo to hi, then infinity and what is no number.

    Bounds on both sides of 0, or far apart, get bins of equal ratio, which leave values within a factor of about 2;
    others get bins of equal width. So no bounds need more than six rounds.
    """
    inf, half = float("inf"), BINS // 2
    near, far = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    ratio = ((lo <= 0) & (hi >= 0)) | (near < far / BINS)
    size = F.floor((F.ln(F.nullif(F.abs(x), F.lit(0.0))) - LEAST_LOG) / (LARGEST_LOG - LEAST_LOG) * (half - 3))
    by_ratio = half + F.coalesce(F.when(x < 0, -1 - size).when(x > 0, 1 + size), F.lit(0))
    by_width = F.least(F.coalesce(F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * (BINS - 1)), F.lit(0)) + 1, F.lit(BINS))
    return F.when(F.isnan(x), BINS + 2).when(x == inf, BINS + 1).when(x == -inf, 0).when(ratio, by_ratio).otherwise(by_width).cast("int")


def _bounds() -> list[Column]:
    """Least and largest value, and the same of the finite ones."""
    finite = F.when(~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    return [F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(finite).alias("flo"), F.max(finite).alias("fhi")]


def _selected(cells: DataFrame, wanted: dict[str, list[float]], by: str) -> DataFrame:
    """(by, m, values): the percentiles of measure number m of each group, from (by, m, x)."""
    stats = cells.groupBy(by, "m").agg(F.count(F.lit(1)).alias("n"), *_bounds())
    shares = F.array(*[F.array(*[F.lit(float(p)) for p in ps]) for ps in wanted.values()])
    state = stats.select("*", F.posexplode(F.get(shares, F.col("m"))).alias("k", "p"))
    position = (F.col("n") - 1) * F.col("p")
    state = state.select(by, "m", "k", position.alias("position"), "lo", "hi", "flo", "fhi", F.explode(F.array_distinct(F.array(F.floor(position), F.ceil(position)))).alias("rank"))
    todo, done = cut(state.withColumn("left", F.col("rank"))), []
    ends = ("lo", "hi", "flo", "fhi")
    while True:
        done.append(todo.filter("lo = hi").select(by, "m", "k", "position", "rank", F.col("lo").alias("value")))
        todo = todo.filter("lo != hi")
        if todo.isEmpty():
            break
        spans = todo.select(by, "m", *ends).distinct().withColumnsRenamed({e: f"_{e}" for e in ends})
        inside = join_null_safe(cells, spans, (by, "m"), "inner").filter(F.col("x").between(F.col("_lo"), F.col("_hi")))
        binned = inside.groupBy(by, "m", "_lo", "_hi", _bin(F.col("x"), F.col("_flo"), F.col("_fhi")).alias("bin")).agg(F.count(F.lit(1)).alias("c"), *_bounds())
        w = Window.partitionBy(by, "m", "_lo", "_hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bin
        bins = cut(binned.withColumn("before", F.coalesce(F.sum("c").over(w), F.lit(0))).drop("bin"))
        old = todo.select(by, "m", "k", "position", "rank", "left", F.col("lo").alias("_lo"), F.col("hi").alias("_hi"))
        new = join_null_safe(old, bins, (by, "m", "_lo", "_hi"), "inner").filter((F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("c")))
        todo = cut(new.select(by, "m", "k", "position", "rank", *ends, (F.col("left") - F.col("before")).alias("left")))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    pair = found.groupBy(by, "m", "k", "position").agg(F.min_by("value", "rank").alias("a"), F.max_by("value", "rank").alias("b"))
    lower, higher = F.floor("position"), F.ceil("position")
    between = (higher - F.col("position")) * F.col("a") + (F.col("position") - lower) * F.col("b")
    value = F.when((higher == lower) | (F.col("a") == F.col("b")), F.col("a")).otherwise(between)
    return pair.groupBy(by, "m").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", value.alias("v")))), lambda e: e["v"]).alias("values"))


def percentiles(df: DataFrame, wanted: dict[str, list[float]], by: str = "date", rows: int = VALUES) -> DataFrame:
    """(by, and for each column named in wanted an array of its percentiles): exact, interpolated, of valid values; null without any.

    Groups of more than so many rows are selected from by rounds of histograms, of which three are usual; the others'
    percentiles come from one aggregation. Both give the same, to the last bit.
    """
    names = list(wanted)
    plain = [F.percentile(c, F.array(*[F.lit(float(p)) for p in ps])).alias(c) for c, ps in wanted.items()]
    large = large_groups(df.select(by), (by,), rows)
    if large is None:
        return df.groupBy(by).agg(*plain)
    rest = join_null_safe(df.select(by, *names), large, (by,)).filter("_rows is null").groupBy(by).agg(*plain)
    each = F.array(*[F.struct(F.lit(m).alias("m"), F.col(c).cast("double").alias("x")) for m, c in enumerate(names)])
    cells = cut(join_null_safe(df.select(by, *names), large, (by,), "inner").select(by, F.inline(each)).filter("x is not null"))
    chosen = _selected(cells, wanted, by).groupBy(by).agg(*[F.max(F.when(F.col("m") == m, F.col("values"))).alias(c) for m, c in enumerate(names)])
    # A group without any valid value still has its row.
    return rest.unionByName(join_null_safe(large.select(by), cut(chosen), (by,)).select(by, *names))

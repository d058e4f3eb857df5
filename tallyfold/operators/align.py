"""Many series on one time axis: as-of joins, merges of new into stored data, duplicates.

Series are long: (series_id, time, value).
"""

from __future__ import annotations

import warnings
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.functions.cells import is_true, ratio_change
from tallyfold.operators.ordered import ROWS, Parts, by_splitters, join_null_safe, last, number, running
from tallyfold.operators.windows import so_far


def union_times(series: DataFrame) -> DataFrame:
    return series.select("time").distinct()


def wanted(series: DataFrame, targets: DataFrame) -> DataFrame:
    """(series_id, time): every series at every distinct target time; as many rows as the answer has. Spark sends a side around if it is small."""
    return series.select("series_id").distinct().crossJoin(targets.filter("time is not null").select("time").distinct())


def as_of(series: DataFrame, targets: DataFrame, extend_last: bool = True, rows: int = ROWS) -> DataFrame:
    """(series_id, time, value, is_real): the last known value at or before each target time.

    is_real tells values observed at that very time from carried ones. Without extend_last, of the targets from a
    series' last time on only the first keeps a value. No range join: observations and targets are sorted together. A
    series with more than so many of both is cut where they lie dense, whatever time that is, and what is known at the
    end of a part, a row for each, is carried into the next. Nothing bounds the number of targets.
    """
    observed = series.filter("time is not null").select("series_id", "time", F.col("value").cast("double").alias("value"))
    both = _with_targets(observed, wanted(series, targets), rows)
    d = running(both, {"_seen": last(F.struct("time", "value"), F.col("kind") == 0)})
    if not extend_last:
        d = running(replace(both, df=d), {"_target": last(F.col("time"), F.col("kind") == 1)}, before=True)
    d = d.filter("kind = 1").withColumn("_seen", F.col("_seen.v"))
    real, value = is_true(F.col("_seen.time") == F.col("time")), F.col("_seen.value")
    if extend_last:
        return d.select("series_id", "time", value.alias("value"), real.alias("is_real"))
    d = join_null_safe(d, series.groupBy("series_id").agg(F.max("time").alias("_last")), ("series_id",), counted=False)
    # Of the targets from the last time on, the first is the one whose target before is earlier, or missing.
    keep = is_true((F.col("time") < F.col("_last")) | F.col("_target").isNull() | (F.col("_target.v") < F.col("_last")))
    return d.select("series_id", "time", F.when(keep, value).alias("value"), (real & keep).alias("is_real"))


def _with_targets(observed: DataFrame, targets: DataFrame, rows: int, by: str = "series_id") -> Parts:
    """Observations (kind 0) and targets (kind 1) in order of time, in parts; at one time observations come first."""
    both = observed.withColumn("kind", F.lit(0)).unionByName(targets.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return by_splitters(both, (by,), [F.col("time"), F.col("kind")], rows)


def exact(series: DataFrame, targets: DataFrame) -> DataFrame:
    """(series_id, time, value) at the target times; missing stays missing."""
    return wanted(series, targets).join(series.select("series_id", "time", "value"), ["series_id", "time"], "left")


def last_known_index(targets: DataFrame, source: DataFrame, by: str = "series_id", rows: int = ROWS) -> DataFrame:
    """(by, target, at): number of the last source value at or before each target, -1 if there is none. Columns: target and source.

    That is how many source values there are up to the target, less 1.
    """
    both = _with_targets(source.select(by, F.col("source").alias("time")), targets.select(by, F.col("target").alias("time")), rows, by)
    d = running(both, {"_n": number(F.col("kind") == 0)}).filter("kind = 1")
    return d.select(by, F.col("time").alias("target"), (F.col("_n") - 1).alias("at"))


def merge(new: DataFrame, old: DataFrame, policy: str = "use_new", max_error: float = 1e-8) -> DataFrame:
    """(series_id, time, value, side, flagged) of new and stored values; side is new, old or both.

    flagged: new / old - 1 is above max_error; only upward changes are, from 0 to anything above it too. policy use_new or use_old picks the value where
    both have one; raise fails if any is flagged.
    """
    n = new.select("series_id", "time", F.struct(F.col("value").alias("v")).alias("n"))
    o = old.select("series_id", "time", F.struct(F.col("value").alias("v")).alias("o"))
    d = n.join(o, ["series_id", "time"], "full_outer")
    nv, ov = F.col("n.v"), F.col("o.v")
    value = F.coalesce(ov, nv) if policy == "use_old" else F.coalesce(nv, ov)
    side = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "old").otherwise("both")
    flagged = is_true(ratio_change(nv, ov) > max_error)
    out = d.select("series_id", "time", value.alias("value"), side.alias("side"), flagged.alias("flagged"))
    if policy == "raise" and not out.filter("flagged").isEmpty():
        raise ValueError("new and stored values differ")
    return out


def merge_summary(merged: DataFrame) -> DataFrame:
    """(series_id, only_new, only_old, both, flagged) counts."""
    n = lambda c: F.sum(c.cast("long"))
    side = F.col("side")
    return merged.groupBy("series_id").agg(n(side == "new").alias("only_new"), n(side == "old").alias("only_old"), n(side == "both").alias("both"), n(F.col("flagged")).alias("flagged"))


def merge_into(new: DataFrame, old: DataFrame | None) -> DataFrame:
    """(series_id, time, value) of stored data with new values put over it; duplicates on either side raise; nothing stored gives the new data."""
    for d in (new, old):
        if d is not None and not d.groupBy("series_id", "time").count().filter("count > 1").isEmpty():
            raise ValueError("a series has two values for one time")
    return new.select("series_id", "time", "value") if old is None else merge(new, old).select("series_id", "time", "value")


def repeats(series: DataFrame) -> DataFrame:
    """(series_id, repeats): how many rows of a series have a time that stands in it already; series without such rows are left out."""
    n = F.count(F.lit(1)) - F.count_distinct(F.coalesce(F.col("time").cast("string"), F.lit("")))
    return series.groupBy("series_id").agg(n.alias("repeats")).filter("repeats > 0")


def drop_duplicates(series: DataFrame, order: str, keep: str = "first", whole_rows: bool = True) -> DataFrame:
    """Of rows with the same series and time (and value, if whole rows) the first or last by source order.

    keep="warn" leaves all rows and warns of the series that have repeated times, with their number.
    """
    if keep == "warn":
        total = repeats(series).agg(F.count(F.lit(1)), F.sum("repeats"), F.min("series_id")).first()
        if total[0]:
            warnings.warn(f"{total[1]} rows of {total[0]} series repeat a time, those of {total[2]} among them", stacklevel=2)
        return series
    by = ["series_id", "time", "value"] if whole_rows else ["series_id", "time"]
    pick = F.min_by if keep == "first" else F.max_by
    kept = series.groupBy(*by).agg(pick(F.struct(*[c for c in series.columns if c not in by]), F.col(order)).alias("_kept"))
    return kept.select(*by, "_kept.*").select(*series.columns)


def new_information(new: DataFrame, old: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(series_id, time, value) of new: values that the stored data lack or that differ by more than the tolerance; else missing."""
    o = old.select("series_id", "time", F.col("value").alias("_old"))
    differs = F.col("_old").isNull() | (F.abs(F.col("value") - F.col("_old")) > tolerance)
    return new.join(o, ["series_id", "time"], "left").select("series_id", "time", F.when(differs, F.col("value")).alias("value"))


def side_by_side(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    return left.join(right, index, "inner")


def trim_idle(df: DataFrame, x: str = "value", by: str = "series_id", order: str = "i") -> DataFrame:
    """x without idle ends: of the leading rows equal to the first value only the last stays, of the trailing ones only the first; a constant series is all missing.

    A missing cell ends a run as a different value does. Both ends come from two aggregations by series, summed up before
    they are shuffled; no task sorts a series.
    """
    v, i = F.col(x), F.col(order)
    valid = F.when(v.isNotNull(), i)
    ends = df.groupBy(by).agg(F.min_by(v, valid).alias("_a"), F.max_by(v, valid).alias("_z"), F.min(valid).alias("_ia"), F.max(valid).alias("_iz"), (F.min(v) != F.max(v)).alias("_varies"))
    d = join_null_safe(df, ends, (by,), counted=False)
    other = lambda end: v.isNull() | (v != F.col(end))
    inner = d.groupBy(by).agg((F.min(F.when((i > F.col("_ia")) & other("_a"), i)) - 1).alias("_from"), (F.max(F.when((i < F.col("_iz")) & other("_z"), i)) + 1).alias("_to"))
    d = join_null_safe(d.drop("_a", "_z", "_ia", "_iz"), inner, (by,), counted=False)
    keep = is_true(F.col("_varies") & (i >= F.col("_from")) & (i <= F.col("_to")))
    return d.withColumn("_keep", keep).withColumn(x, F.when(F.col("_keep"), v)).drop("_varies", "_from", "_to", "_keep")


def attach_mean(df: DataFrame, mean_id: str = "mean") -> DataFrame:
    """(series_id, i, value) with one series more: the value of an equal-weight holding, from 1, its idle ends trimmed."""
    w = Window.partitionBy("series_id").orderBy("i")
    ret = F.when(F.col("i") == 0, 0.0).otherwise(F.col("value") / F.nullif(F.lag("value").over(w), F.lit(0.0)) - 1)
    mean = df.select("i", ret.alias("r")).groupBy("i").agg(F.coalesce(F.avg("r"), F.lit(0.0)).alias("r"))
    nav = mean.select(F.lit(mean_id).alias("series_id"), "i", F.product(1 + F.col("r")).over(so_far(Window.orderBy("i"))).alias("value"))
    return df.select(F.col("series_id").cast("string"), "i", "value").unionByName(trim_idle(nav))


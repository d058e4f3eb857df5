"""Correlation of series, and greedy grouping of the result."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.operators.grouping import grouped_by_rounds, thresholds_by_rounds
from tallyfold.operators.panel import MAX_DATES
from tallyfold.sources.storage import cut, few, ship

#: A universe whose correlation matrix one task groups has at most so many series; larger ones take rounds of jobs.
MAX_SERIES = 5000
#: Rows of (series, date) that one task of pairwise_blocked gets on average.
BLOCK_CELLS = 4_000_000


def pairwise(returns: DataFrame) -> DataFrame:
    """(a, b, corr) of (series_id, i, ret): correlation over the rows where both are valid, both orders and the diagonal; -1 where undefined.

    Pairs a <= b meet on their common rows; sums are aggregated before the shuffle.
    """
    x = returns.filter(F.col("ret").isNotNull())
    left, right = x.select(F.col("series_id").alias("a"), "i", F.col("ret").alias("x")), x.select(F.col("series_id").alias("b"), "i", F.col("ret").alias("y"))
    half = left.join(right, "i").filter("a <= b").groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))
    mirrored = half.unionByName(half.filter("a < b").select(F.col("b").alias("a"), F.col("a").alias("b"), "corr"))
    ids = returns.select("series_id").distinct()
    grid = ids.select(F.col("series_id").alias("a")).crossJoin(ids.select(F.col("series_id").alias("b")))
    value = F.nullif(F.col("corr"), F.lit(float("nan")))
    value = F.when((F.col("a") == F.col("b")) & value.isNotNull(), 1.0).otherwise(value)  # exactly, so that equal means stay equal
    return grid.join(mirrored, ["a", "b"], "left").select("a", "b", F.coalesce(value, F.lit(-1.0)).alias("corr"))


def pairwise_blocked(returns: DataFrame, blocks: int | None = None, universe: str | None = None) -> DataFrame:
    """As pairwise, for many series: (a, b, corr) by pairs of blocks of series; with a universe, (universe, a, b, corr) within each.

    Series are dealt into blocks by a hash of their id; each pair of blocks is one task of matrix products over the two
    blocks' valid cells. A row is sent to as many tasks as there are blocks, rather than to one for each partner. There
    are as many blocks as keep a task of the largest universe at BLOCK_CELLS rows.
    """
    u = F.col(universe) if universe else F.lit(0)
    if blocks is None:
        most = returns.groupBy(u.alias("_u")).count().agg(F.max("count")).first()[0] or 0
        blocks = max(1, -(-2 * most // BLOCK_CELLS))
    series = returns.schema["series_id"].dataType.simpleString()
    own = F.pmod(F.xxhash64(F.col("series_id").cast("string")), F.lit(blocks)).cast("int")
    placed = returns.select(u.alias("_u"), "series_id", "i", F.col("ret").cast("double").alias("ret"), own.alias("own"))
    others = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda k: F.struct(F.least(F.col("own"), k).alias("p"), F.greatest(F.col("own"), k).alias("q")))
    dealt = placed.select("*", F.inline(others))
    ship(returns.sparkSession)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = pdf["p"].iloc[0], pdf["q"].iloc[0]
        wide = pdf.pivot(index="i", columns="series_id", values="ret").sort_index().sort_index(axis=1)
        side = pdf.drop_duplicates("series_id").set_index("series_id")["own"].reindex(wide.columns).to_numpy()
        x = wide.to_numpy(float)
        ok = ~np.isnan(x)
        with np.errstate(invalid="ignore", divide="ignore"):
            x = np.where(ok, x - np.where(ok, x, 0).sum(axis=0) / ok.sum(axis=0), 0.0)  # centred, against loss of digits
        a, b = np.flatnonzero(side == p), np.flatnonzero(side == q)
        ma, mb, xa, xb = ok[:, a].astype(float), ok[:, b].astype(float), x[:, a], x[:, b]
        n, sa, sb = ma.T @ mb, xa.T @ mb, ma.T @ xb
        cov, va, vb = n * (xa.T @ xb) - sa * sb, n * ((xa**2).T @ mb) - sa**2, n * (ma.T @ xb**2) - sb**2
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.where((n > 1) & (va > 0) & (vb > 0), cov / np.sqrt(va * vb), np.nan)
        c = np.where(np.isnan(c), -1.0, np.clip(c, -1, 1))
        names = wide.columns.to_numpy()
        c[names[a][:, None] == names[b][None, :]] = np.where(c[names[a][:, None] == names[b][None, :]] > 0, 1.0, -1.0)
        out = pd.DataFrame({"a": np.repeat(names[a], len(b)), "b": np.tile(names[b], len(a)), "corr": c.ravel()})
        out = out if p == q else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})[["a", "b", "corr"]]])
        return out.assign(_u=pdf["_u"].iloc[0])[["_u", "a", "b", "corr"]]

    out = dealt.groupBy("_u", "p", "q").applyInPandas(sums, f"_u {dealt.schema['_u'].dataType.simpleString()}, a {series}, b {series}, corr double")
    return out.withColumnRenamed("_u", universe) if universe else out.drop("_u")


def one_group(m: np.ndarray, threshold: float) -> list[int]:
    """The member of the largest mean correlation, then whoever fits best of those above the threshold with all members."""
    group = [int(np.argmax(m.mean(axis=1)))]
    left = np.ones(len(m), dtype=bool)
    left[group] = False
    while left.any():
        to_group = m[np.ix_(group, np.flatnonzero(left))]
        fit = np.where(to_group.min(axis=0) > threshold, to_group.mean(axis=0), -np.inf)
        if not np.isfinite(fit).any():
            break
        new = int(np.flatnonzero(left)[np.argmax(fit)])
        group.append(new)
        left[new] = False
    return group


def one_level(m: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Groups until none is left; members by order of joining."""
    left, groups = np.arange(len(m)), []
    while len(left):
        group = left[one_group(m[np.ix_(left, left)], threshold)]
        groups.append(group)
        left = left[~np.isin(left, group)]
    return groups


def best_threshold(m: np.ndarray, steps: int = 20) -> float:
    """Of steps + 1 thresholds from the least to the largest correlation, the one with the best mean within groups for their number, both scaled to [0, 1]; the lowest of equals."""
    levels = np.linspace(m.min(), m.max(), steps + 1)
    labels = np.zeros((len(levels), len(m)), dtype=int)  # the group of each series at each threshold
    for row, level in zip(labels, levels, strict=True):
        for k, members in enumerate(one_level(m, level)):
            row[members] = k
    together = [row[:, None] == row for row in labels]
    quality = np.array([np.stack([m[pairs].mean() for pairs in together]), -labels.max(axis=1)])
    low, high = quality.min(axis=1, keepdims=True), quality.max(axis=1, keepdims=True)
    return float(levels[np.argmax(((quality - low) / np.where(high > low, high - low, 1.0)).sum(axis=0))])


def tree_order(m: np.ndarray, thresholds: list[float] | None = None, path: tuple[int, ...] = (), further: bool = False) -> list[tuple[int, tuple[int, ...]]]:
    """(member, path of group numbers) in display order. Given thresholds are used level by level; without any, or further than those given, each level finds its own until it no longer splits."""
    auto = not thresholds
    t = best_threshold(m) if auto else thresholds[0]
    deeper = len(m) > 1 and (t > m.min() if auto else len(thresholds) > 1 or further)
    out = []
    for k, g in enumerate(one_level(m, t)):
        here = (*path, k)
        if deeper:
            out += [(int(g[i]), p) for i, p in tree_order(m[np.ix_(g, g)], None if auto else thresholds[1:], here, further)]
        else:
            out += [(int(i), here) for i in g]
    return out


def _solved(pairs: DataFrame, universe: str | None, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str, rounds: Callable[[DataFrame], DataFrame], most: int) -> DataFrame:
    """solve, of one universe's matrix as a data frame, in a task for each universe of at most so many series; rounds, of (u, a, b, corr), for the others. Pairs are counted before any is handed to Python."""
    u = F.col(universe) if universe else F.lit(0)
    keyed = cut(pairs.select(u.alias("_u"), F.coalesce(F.concat(F.lit("u"), u.cast("string")), F.lit("")).alias("u"), "a", "b", "corr"))
    large = cut(keyed.groupBy("u").count().filter(F.col("count") > most**2).select("u"))
    large = F.broadcast(large) if few(large) else large
    kind = keyed.schema["_u"].dataType.simpleString()

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot(index="a", columns="b", values="corr").sort_index().sort_index(axis=1)
        return solve(m).assign(_u=pdf["_u"].iloc[0])

    ship(pairs.sparkSession)
    out = keyed.join(large, "u", "left_anti").drop("u").groupBy("_u").applyInPandas(each, f"_u {kind}, {schema}")
    if not large.isEmpty():
        wide = rounds(keyed.join(large, "u", "left_semi").drop("_u"))
        out = out.unionByName(wide.select(F.when(F.col("u") != "", F.substring("u", 2, 1 << 30)).cast(kind).alias("_u"), *out.columns[1:]))
    return out.withColumnRenamed("_u", universe) if universe else out.drop("_u")


def grouped(pairs: DataFrame, thresholds: list[float] | None = None, universe: str | None = None, most: int | None = None, further: bool = False) -> DataFrame:
    """(series_id, order_no, path) of pairs (a, b, corr); with a universe, (universe, series_id, order_no, path).

    Thresholds are those of tree_order. A universe is one task's work up to most (MAX_SERIES) series, and rounds of Spark jobs beyond. Its pairs are a whole matrix,
    both orders and the diagonal.
    """

    most = MAX_SERIES if most is None else most

    def solve(m: pd.DataFrame) -> pd.DataFrame:
        rows = tree_order(m.to_numpy(float), thresholds, further=further)
        return pd.DataFrame({"series_id": [m.index[i] for i, _ in rows], "order_no": range(len(rows)), "path": [list(p) for _, p in rows]})

    schema = f"series_id {pairs.schema['a'].dataType.simpleString()}, order_no long, path array<int>"
    return _solved(pairs, universe, solve, schema, lambda p: grouped_by_rounds(p, thresholds, one_level, tree_order, most, further), most)


def chosen_threshold(pairs: DataFrame, universe: str | None = None, most: int | None = None) -> DataFrame:
    """(threshold) that best_threshold picks for all pairs, or (universe, threshold) for those of each universe."""
    most = MAX_SERIES if most is None else most
    solve = lambda m: pd.DataFrame({"threshold": [best_threshold(m.to_numpy(float))]})
    return _solved(pairs, universe, solve, "threshold double", lambda p: thresholds_by_rounds(p, one_level, most), most)


def sorted_matrix(pairs: DataFrame, order: DataFrame, universe: str | None = None) -> DataFrame:
    """(a, b, row_no, col_no, corr), with the universe before them, in display order; undefined is missing."""
    u = [universe] if universe else []
    place = lambda side, name: order.select(*u, F.col("series_id").alias(side), F.col("order_no").alias(name))
    d = pairs.join(place("a", "row_no"), [*u, "a"]).join(place("b", "col_no"), [*u, "b"])
    return d.select(*u, "a", "b", "row_no", "col_no", F.when(F.col("corr") != -1, F.col("corr")).alias("corr"))


def matrix_rows(sorted_pairs: DataFrame, universe: str | None = None) -> DataFrame:
    """(row_no, a, corr), with the universe before them: the sorted matrix, a row for each series with its correlations as an array in display order."""
    u = [universe] if universe else []
    cells = F.sort_array(F.collect_list(F.struct("col_no", "corr")))  # one row of the matrix
    return sorted_pairs.groupBy(*u, "row_no", "a").agg(F.transform(cells, lambda x: x["corr"]).alias("corr"))


def rescaled(df: DataFrame, universe: str | None = None) -> DataFrame:
    """(series_id, i, value), with the universe before them: series scaled so that one that starts, or starts again, does so on the level of a running main series.

    The main series is the one whose mean step from there to its end is closest to the average; it runs until it has a
    missing value. Every series gets every date of its universe. Only one row for each date meets in a task: a start
    overrides the scale of those before it, so that a series' scale is the level at its last start over its own value
    there. A series whose last start is at zero can't be scaled: it is missing.
    """
    cells = df.select((F.coalesce(F.concat(F.lit("u"), F.col(universe).cast("string")), F.lit("")) if universe else F.lit("")).alias("_u"), "series_id", F.col("i").alias("t"), F.nullif(F.col("value").cast("double"), F.lit(float("nan"))).alias("v"))
    days = cells.select("_u", "t").distinct().groupBy("_u").agg(F.sort_array(F.collect_list("t")).alias("days"))
    refused = F.raise_error(F.lit(f"more than {MAX_DATES} dates")).cast(days.schema["days"].dataType)
    days = days.select("_u", F.when(F.size("days") <= MAX_DATES, F.col("days")).otherwise(refused).alias("days"))
    one = (lambda x: x) if universe else F.broadcast  # a row for each date of one universe, but not of many
    grid = cells.select("_u", "series_id").distinct().join(one(days), "_u").select("_u", "series_id", F.posexplode("days").alias("i", "t"))
    d = grid.join(cells, ["_u", "series_id", "t"], "left")

    w = Window.partitionBy("_u", "series_id").orderBy("i")
    whole, ahead, before = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, -1)
    ok = F.col("v").isNotNull()
    d = d.withColumn("start", F.when(ok & F.lag("v").over(w).isNull(), F.struct("i", "v")))
    end, last = F.max(F.when(ok, F.col("i"))).over(whole) + 1, F.last("v", ignorenulls=True).over(whole)
    d = d.select("*", F.when(ok, (last - F.col("v")) / (end - F.col("i"))).alias("step"), F.min(F.when(~ok, F.col("i"))).over(ahead).alias("stop"), F.last("start", ignorenulls=True).over(before).alias("was"), F.last("start", ignorenulls=True).over(whole).alias("final"))
    d = cut(d.select("_u", "series_id", "i", "t", "v", "step", "stop", "was", "final"))

    means = d.groupBy("_u", "i").agg(F.avg("step").alias("mean"))
    near = d.filter(F.col("step").isNotNull()).join(one(means), ["_u", "i"]).select("_u", "i", "series_id", "stop", F.abs(F.col("step") - F.col("mean")).alias("far"))
    best = near.groupBy("_u", "i").agg(F.min(F.struct("far", "series_id", "stop")).alias("m")).select("_u", "i", "m.series_id", "m.stop")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Main series by date, from each date's best one and where that stops."""
        pdf = pdf.sort_values("i")
        rows, until = [], -1
        for i, series, stop in zip(pdf["i"], pdf["series_id"], pdf["stop"], strict=True):
            if i >= until:
                until, main = (np.inf if pd.isna(stop) else stop), series
                rows.append((pdf["_u"].iloc[0], main, i, until - 1 if until < np.inf else MAX_DATES))
        return pd.DataFrame(rows, columns=["_u", "series_id", "lo", "hi"])

    def levels(pdf: pd.DataFrame) -> pd.DataFrame:
        """Level by date, from the main series' own values and where they started last."""
        pdf = pdf.sort_values("i")
        found: dict[int, float] = {}
        for i, v, at, first in zip(pdf["i"], pdf["v"], pdf["was_i"], pdf["was_v"], strict=True):
            found[i] = v if pd.isna(at) else v * (found[int(at)] / first if first else np.nan)
        return pd.DataFrame({"_u": pdf["_u"], "at": pdf["i"], "level": list(found.values())})

    ship(df.sparkSession)
    kind = d.schema["series_id"].dataType.simpleString()
    mains = one(cut(best.groupBy("_u").applyInPandas(chain, f"_u string, series_id {kind}, lo long, hi long")))
    held = d.join(mains, ["_u", "series_id"]).filter(F.col("i").between(F.col("lo"), F.col("hi"))).select("_u", "i", "v", F.col("was.i").alias("was_i"), F.col("was.v").alias("was_v"))
    level = one(held.groupBy("_u").applyInPandas(levels, "_u string, at int, level double"))
    out = d.withColumn("at", F.col("final.i")).join(level, ["_u", "at"], "left")
    given = [F.substring("_u", 2, 1 << 30).cast(df.schema[universe].dataType).alias(universe)] if universe else []
    return out.select(*given, "series_id", F.col("t").cast("long").alias("i"), (F.col("v") * (F.col("level") / F.nullif(F.col("final.v"), F.lit(0.0)))).alias("value"))

"""Greedy grouping of universes whose correlations are too many for one task, by rounds over a stored matrix.

The matrix is stored once, by slabs of its rows, so that a round reads the slabs it needs. A round forms one group in each
cell (a universe, or a group that is split further) at once: the series with the largest summed correlation founds it,
and those above the threshold with the founder are candidates, with their sum and least correlation to the group so far.
While candidates are too many for one task, an aggregation finds the next member; the rest is recruited in one task for
each cell. When few series of a cell are left, one task finishes it. Sums over series are decimal, so that ties are ties
in whatever order Spark adds: they go to who joined the group that is split earlier, or else to the smaller series.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.sources.storage import cut, discard, scratch, ship

#: Correlations in a slab of the matrix, and the most slabs there are.
SLAB_PAIRS, MAX_SLABS = 4_000_000, 1000
#: Thresholds tried between the least and the largest correlation.
STEPS = 20
CELL = ["u", "c"]
KEYS = ["u", "c", "k"]


def _exact(x: Column) -> Column:
    return x.cast("decimal(38,17)")


def _place(name: str, slabs: int) -> Column:
    return F.pmod(F.xxhash64("u", F.col(name)), F.lit(slabs)).cast("int")


class Matrix:
    """(u, a, b, corr), both orders and the diagonal, in the shared folder by slabs of a."""

    def __init__(self, pairs: DataFrame):
        self.spark = pairs.sparkSession
        self.slabs = int(min(MAX_SLABS, 1 + pairs.count() // SLAB_PAIRS))
        self.folder = scratch(self.spark, "matrix")
        pairs.select("u", "a", "b", "corr", _place("a", self.slabs).alias("slab")).repartition(self.slabs, "slab").write.partitionBy("slab").parquet(self.folder)
        self.all = self.spark.read.parquet(self.folder)

    def of(self, members: DataFrame) -> DataFrame:
        """The matrix rows of members (.., u, s), with members' other columns; only their slabs are read."""
        wanted = [r["slab"] for r in members.select(_place("s", self.slabs).alias("slab")).distinct().collect()]
        return self.all.filter(F.col("slab").isin(wanted)).drop("slab").join(members.withColumnRenamed("s", "a"), ["u", "a"])

    def within(self, members: DataFrame, keys: list[str]) -> DataFrame:
        """Correlations of members with members of the same keys, with the columns of the row's member."""
        return self.of(members).join(members.select(*keys, F.col("s").alias("b")), [*keys, "b"])


def recruits(m: np.ndarray, total: np.ndarray, least: np.ndarray, threshold: float) -> list[int]:
    """Candidates by order of joining a group to which their correlations sum to total and are at least least."""
    total, least, left, order = total.copy(), least.copy(), np.ones(len(m), dtype=bool), []
    while (left & (least > threshold)).any():
        new = int(np.argmax(np.where(left & (least > threshold), total, -np.inf)))
        order.append(new)
        left[new] = False
        total, least = total + m[new], np.minimum(least, m[new])
    return order


class _Pieces:
    """Groups found so far: (u, c, k, s, g, j), a small table for each step of a round."""

    def __init__(self, matrix: Matrix):
        self.spark, self.folder, self.number = matrix.spark, scratch(matrix.spark, "groups"), 0

    def add(self, df: DataFrame) -> None:
        df.select(*KEYS, "s", F.col("g").cast("int").alias("g"), F.col("j").cast("int").alias("j")).write.parquet(f"{self.folder}/piece={self.number}")
        self.number += 1

    def read(self, since: int = 0) -> DataFrame:
        return self.spark.read.parquet(self.folder).filter(F.col("piece") >= since).drop("piece")


def _best(df: DataFrame) -> DataFrame:
    """By cell, the series s of the largest total; of equals the first by o and s."""
    return df.groupBy(*KEYS, "t").agg(F.min(F.struct((-F.col("total")).alias("minus"), "o", "s"))["s"].alias("s"))


def _square(pdf: pd.DataFrame) -> pd.DataFrame:
    """One matrix of (a, b, corr), its series by o and name."""
    order = pdf[["o", "a"]].drop_duplicates("a").sort_values(["o", "a"])["a"]
    return pdf.pivot(index="a", columns="b", values="corr").reindex(index=order, columns=order)


def level(matrix: Matrix, cells: DataFrame, tried: DataFrame, one_level: Callable, local: int) -> DataFrame:
    """(u, c, k, s, g, j): group number and order of joining of each series of cells (u, c, s, o), for each threshold (u, c, k, t) tried.

    A task gets the correlations of at most local series. Orders of joining rise, but not always by one.
    """
    series, cell = cells.schema["s"].dataType.simpleString(), cells.schema["c"].dataType.simpleString()
    ids, pieces = f"u string, c {cell}, k int, s {series}", _Pieces(matrix)
    totals = matrix.within(cells, CELL).groupBy(*CELL, F.col("a").alias("s"), "o").agg(_exact(F.sum(_exact(F.col("corr")))).alias("total"))
    state = cut(totals.join(tried, CELL).select(*KEYS, "t", "s", "o", "total"))
    ship(matrix.spark)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _square(pdf)
        rows = [(m.index[i], g, j) for g, members in enumerate(one_level(m.to_numpy(float), pdf["t"].iloc[0])) for j, i in enumerate(members)]
        out = pd.DataFrame(rows, columns=["s", "g", "j"])
        return out.assign(u=pdf["u"].iloc[0], k=pdf["k"].iloc[0], c=[pdf["c"].iloc[0]] * len(out))[["u", "c", "k", "s", "g", "j"]]

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _square(pdf)
        own = pdf.drop_duplicates("a").set_index("a").reindex(m.index)
        order = recruits(m.to_numpy(float), own["total"].to_numpy(float), own["least"].to_numpy(float), pdf["t"].iloc[0])
        out = pd.DataFrame({"s": [m.index[i] for i in order], "j": range(len(order))})
        return out.assign(u=pdf["u"].iloc[0], k=pdf["k"].iloc[0], c=[pdf["c"].iloc[0]] * len(out))[["u", "c", "k", "s", "j"]]

    g = 0
    while not state.isEmpty():
        sizes = cut(state.groupBy(*KEYS).count())
        near = state.join(sizes.filter(F.col("count") <= local).drop("count"), KEYS)
        if not near.isEmpty():
            ends = matrix.within(near.drop("total"), KEYS).select(*KEYS, "t", "o", "a", "b", "corr")
            pieces.add(ends.groupBy(*KEYS).applyInPandas(finish, f"{ids}, g int, j int").withColumn("g", F.col("g") + g))
            state = state.join(sizes.filter(F.col("count") > local).drop("count"), KEYS)
            if state.isEmpty():
                break

        since, founders = pieces.number, cut(_best(state))
        pieces.add(founders.withColumns({"g": F.lit(g), "j": F.lit(0)}))
        fits = matrix.of(founders).filter((F.col("corr") > F.col("t")) & (F.col("a") != F.col("b"))).withColumnRenamed("b", "s")
        fits = fits.join(state.select(*KEYS, "s", "o"), [*KEYS, "s"])  # those left in the founder's cell
        fits = cut(fits.select(*KEYS, "t", "s", "o", _exact(F.col("corr")).alias("total"), F.col("corr").alias("least")))
        j = 1
        while True:
            wide = cut(fits.groupBy(*KEYS).count().filter(F.col("count") > local).drop("count"))
            if wide.isEmpty():
                break
            new = cut(_best(fits.join(wide, KEYS)))
            pieces.add(new.withColumns({"g": F.lit(g), "j": F.lit(j)}))
            row = matrix.of(new.drop("t")).select(*KEYS, F.col("b").alias("s"), "corr", (F.col("a") == F.col("b")).alias("joined"))
            met = fits.join(row, [*KEYS, "s"], "left").filter(~F.coalesce("joined", F.lit(False)))
            met = met.select(*KEYS, "t", "s", "o", _exact(F.col("total") + F.coalesce(_exact(F.col("corr")), F.lit(0))).alias("total"), F.least("least", "corr").alias("least"))
            fits = cut(met.filter(F.col("least") > F.col("t")))
            j += 1
        if not fits.isEmpty():
            last = matrix.within(fits, KEYS).select(*KEYS, "t", "o", "a", "b", "corr", F.col("total").cast("double").alias("total"), "least")
            pieces.add(last.groupBy(*KEYS).applyInPandas(fill, f"{ids}, j int").withColumns({"g": F.lit(g), "j": F.col("j") + j}))

        gone = pieces.read(since).select(*KEYS, "s")
        lost = matrix.of(gone).groupBy(*KEYS, F.col("b").alias("s")).agg(_exact(F.sum(_exact(F.col("corr")))).alias("lost"))
        left = state.join(gone, [*KEYS, "s"], "left_anti").join(lost, [*KEYS, "s"], "left")
        state = cut(left.select(*KEYS, "t", "s", "o", _exact(F.col("total") - F.coalesce("lost", F.lit(0))).alias("total")))
        g += 1
    out = cut(pieces.read())
    discard(matrix.spark, pieces.folder)
    return out


def best_thresholds(matrix: Matrix, cells: DataFrame, one_level: Callable, local: int) -> DataFrame:
    """(u, c, t, low) of each cell: of STEPS + 1 thresholds from low, the least correlation, to the largest, the one with the best mean within groups for their number, both scaled to [0, 1]; the lowest of equals."""
    span = matrix.within(cells, CELL).groupBy(*CELL).agg(F.min("corr").alias("low"), F.max("corr").alias("high"))
    value = lambda k: F.when(k == STEPS, F.col("high")).otherwise(k * ((F.col("high") - F.col("low")) / STEPS) + F.col("low"))
    tried = cut(span.select(*CELL, "low", F.explode(F.sequence(F.lit(0), F.lit(STEPS))).alias("k"), "high").select(*CELL, "low", "k", value(F.col("k")).alias("t")))
    found = level(matrix, cells, tried.drop("low"), one_level, local)
    labels = found.groupBy(*CELL, "s").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "g"))), lambda x: x["g"]).alias("g"))  # STEPS + 1 numbers
    both = matrix.of(labels.withColumnRenamed("g", "ga")).join(labels.select(*CELL, F.col("s").alias("b"), F.col("g").alias("gb")), [*CELL, "b"])
    means = both.groupBy(*CELL).agg(*(F.avg(F.when(F.col("ga")[k] == F.col("gb")[k], F.col("corr"))).alias(f"m{k}") for k in range(STEPS + 1)))
    means = means.select(*CELL, F.posexplode(F.array(*(f"m{k}" for k in range(STEPS + 1)))).alias("k", "mean"))
    q = means.join(found.groupBy(*KEYS).agg((-F.max("g")).cast("double").alias("number")), KEYS).join(tried, KEYS)
    all_tried = Window.partitionBy(*CELL)  # STEPS + 1 rows

    def scaled(x: str) -> Column:
        low, high = F.min(x).over(all_tried), F.max(x).over(all_tried)
        return (F.col(x) - low) / F.when(high > low, high - low).otherwise(1.0)

    scores = q.select(*CELL, "t", "low", F.struct((scaled("mean") + scaled("number")).alias("score"), (-F.col("k")).alias("first")).alias("score"))
    return cut(scores.groupBy(*CELL).agg(F.max_by("t", "score").alias("t"), F.first("low").alias("low")))


def _start(matrix: Matrix) -> DataFrame:
    """Every universe as one cell, with an empty path."""
    return cut(matrix.all.filter(F.col("a") == F.col("b")).select("u", F.array().cast("array<int>").alias("c"), F.col("a").alias("s"), F.lit(0).alias("o")).distinct())


def thresholds_by_rounds(pairs: DataFrame, one_level: Callable, local: int) -> DataFrame:
    """(u, threshold) for pairs (u, a, b, corr)."""
    matrix = Matrix(pairs)
    return best_thresholds(matrix, _start(matrix), one_level, local).select("u", F.col("t").alias("threshold"))


def _split_further(tree_order: Callable, thresholds: list[float] | None, further: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """tree_order of one group, below the path it has."""

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        m = _square(pdf)
        rows = tree_order(m.to_numpy(float), thresholds, tuple(int(x) for x in pdf["c"].iloc[0]), further)
        return pd.DataFrame({"u": pdf["u"].iloc[0], "path": [list(p) for _, p in rows], "s": [m.index[i] for i, _ in rows], "j": range(len(rows))})

    return ordered


def grouped_by_rounds(pairs: DataFrame, thresholds: list[float] | None, one_level: Callable, tree_order: Callable, local: int, further: bool = False) -> DataFrame:
    """(u, series_id, order_no, path) for pairs (u, a, b, corr), a matrix for each u: as tree_order gives for one.

    Groups of at most local series are split further in one task each. Numbering sorts the series of a universe, not
    their pairs, in one task.
    """
    matrix = Matrix(pairs)
    series = pairs.schema["a"].dataType.simpleString()
    cells, found, depth = _start(matrix), [], 0
    while not cells.isEmpty():
        given = (thresholds or [])[depth:]
        if given:
            deeper = F.lit(len(given) > 1 or further)
            tried = cells.select(*CELL).distinct().select(*CELL, F.lit(0).alias("k"), F.lit(float(given[0])).alias("t"), deeper.alias("deeper"))
        else:
            best = best_thresholds(matrix, cells, one_level, local)
            tried = best.select(*CELL, F.lit(0).alias("k"), "t", (F.col("t") > F.col("low")).alias("deeper"))
        tried = cut(tried)
        groups = level(matrix, cells, tried.drop("deeper"), one_level, local).join(tried, KEYS)
        groups = groups.select("u", F.concat("c", F.array("g")).alias("c"), "s", "j", "deeper")
        found.append(groups.filter(~F.col("deeper")).select("u", F.col("c").alias("path"), "s", "j"))
        sizes = groups.filter("deeper").groupBy(*CELL).count()
        split = cut(groups.filter("deeper").join(sizes, CELL))

        small = split.filter(F.col("count") <= local).select(*CELL, "s", F.col("j").alias("o"))
        if not small.isEmpty():
            own = matrix.within(small, CELL).select(*CELL, "o", "a", "b", "corr")
            found.append(cut(own.groupBy(*CELL).applyInPandas(_split_further(tree_order, given[1:] or None, further), f"u string, path array<int>, s {series}, j int")))
        cells = cut(split.filter(F.col("count") > local).select(*CELL, "s", F.col("j").alias("o")))
        depth += 1
    every = reduce(DataFrame.unionByName, found)
    number = F.row_number().over(Window.partitionBy("u").orderBy("path", "j")) - 1
    return every.select("u", F.col("s").alias("series_id"), number.cast("long").alias("order_no"), "path")

"""Long ordered groups in parts, so that no task gets a whole group: splitters, halos, and states carried from part to part.

A group is cut into parts that follow each other in the group's order. What a row needs of the rows before it is
worked out within its part, and what is known when a part begins, a row for each part, is put on top. Rolling windows
need no such state: the last rows of a part are sent along to the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyfold.functions.cells import is_true
from tallyfold.sources.storage import cut, few

#: Rows that a part has, about; a group of no more is one part.
ROWS = 1_000_000
#: Rows of a part that are looked at to place the splitters.
SAMPLES = 64
#: Rows of an asset that one block of dense rows has.
BLOCK = 100_000


@dataclass(frozen=True)
class Parts:
    """df has a column _part. by: the group; order: what its rows are in order of; split: whether any group has several parts."""

    df: DataFrame
    by: tuple[str, ...]
    order: tuple[Column, ...]
    split: bool

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by, "_part").orderBy(*self.order)


def join_null_safe(df: DataFrame, other: DataFrame, keys: tuple[str, ...], how: str = "left", counted: bool = True) -> DataFrame:
    """df with the other's columns, joined on keys of which null equals null. If counted, which the other has been cut for, it is sent to all executors where it is small; else Spark finds out as it goes."""
    other = other.select(*[F.col(k).alias(f"_key{j}") for j, k in enumerate(keys)], *[c for c in other.columns if c not in keys])
    met = F.lit(True)
    for j, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_key{j}"))
    return df.join(F.broadcast(other) if counted and few(other) else other, met, how).drop(*[f"_key{j}" for j in range(len(keys))])


def large_groups(df: DataFrame, by: tuple[str, ...], rows: int) -> DataFrame | None:
    """(by, _rows) of groups with more than so many rows; None where there are none. Counting them is a job of its own."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    most = sizes.agg(F.max("_rows")).first()[0]
    return None if most is None or most <= rows else cut(sizes.filter(F.col("_rows") > rows))


def _search(edges: Column, key: Column) -> Column:
    """How many of the sorted edges are smaller than the key, by halving."""
    steps = F.array(*[F.lit(1 << k) for k in range(24, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(edges)) & is_true(F.get(edges, at + s - 1) < key), at + s).otherwise(at))


def by_splitters(df: DataFrame, by: tuple[str, ...], order: list[Column], rows: int = ROWS) -> Parts:
    """Groups cut at splitters into parts of about so many rows; equal rows stay together.

    The rows are counted by group. Of groups that are too large, rows chosen by a hash are put in order, SAMPLES for each
    part, and give the splitters, which are all that is sent around.
    """
    large = large_groups(df, by, rows)
    if large is None:
        return Parts(df.withColumn("_part", F.lit(0)), by, tuple(order), False)
    key = F.struct(*[c.alias(f"k{j}") for j, c in enumerate(order)])
    every = max(1, rows // SAMPLES)
    seen = df.filter(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(*by, key.alias("_key"))
    seen = join_null_safe(seen, large, by, "inner").groupBy(*by).agg(F.sort_array(F.collect_list("_key")).alias("_seen"), F.first("_rows").alias("_rows"))
    parts = F.least(F.ceil(F.col("_rows") / rows), F.size("_seen") + 1).cast("int")
    edges = F.transform(F.sequence(F.lit(1), parts - 1), lambda j: F.get("_seen", F.floor(j * F.size("_seen") / parts).cast("int")))
    edges = cut(seen.filter(parts > 1).select(*by, F.array_distinct(edges).alias("_edges")))
    d = join_null_safe(df, edges, by)
    return Parts(d.withColumn("_part", F.when(F.col("_edges").isNull(), 0).otherwise(_search(F.col("_edges"), key))).drop("_edges"), by, tuple(order), True)


def by_number(df: DataFrame, by: tuple[str, ...] = ("asset",), i: str = "i", rows: int = BLOCK, most: int | None = None) -> Parts:
    """Dense groups, whose rows are numbered by i from 0, cut into blocks of so many rows. most: rows of the longest group, where known; else a job finds out."""
    if most is None:
        last = df.agg(F.max(i)).first()[0]
        most = 0 if last is None else last + 1
    split = most > rows
    return Parts(df.withColumn("_part", F.floor(F.col(i) / rows).cast("int") if split else F.lit(0)), by, (F.col(i),), split)


@dataclass(frozen=True)
class State:
    """What is carried: value of each row; over a frame, over a whole part (given its order), over the parts before, and the two put together."""

    value: Column
    over: Callable[[Column, WindowSpec], Column]
    whole: Callable[[Column, Column], Column]
    merge: Callable[[Column, WindowSpec], Column]
    join: Callable[[Column, Column], Column]
    end: Callable[[Column], Column] = lambda x: x


def last(value: Column, take: Column) -> State:
    """The value, null too, of the last row with take; null if there is none. As a struct of v, which is null without such a row."""
    taken = is_true(take)
    return State(
        F.when(taken, F.struct(value.alias("v"))),
        lambda v, w: F.last(v, ignorenulls=True).over(w),
        lambda v, at: F.max_by(v, F.when(v.isNotNull(), at)),
        lambda v, w: F.last(v, ignorenulls=True).over(w),
        lambda before, own: F.coalesce(own, before),
    )


def last_value(value: Column) -> State:
    """The last value that is not null."""
    s = last(value, value.isNotNull())
    return State(s.value, s.over, s.whole, s.merge, s.join, lambda x: x["v"])


def total(value: Column) -> State:
    """The sum; null of nothing."""
    add = lambda v, w: F.sum(v).over(w)
    return State(value, add, lambda v, at: F.sum(v), add, lambda a, b: F.coalesce(a + b, a, b))


def number(condition: Column) -> State:
    """How many rows meet the condition."""
    s = total(is_true(condition).cast("long"))
    return State(s.value, s.over, s.whole, s.merge, s.join, lambda x: F.coalesce(x, F.lit(0).cast("long")))


def product(value: Column) -> State:
    times = lambda v, w: F.product(v).over(w)
    return State(value, times, lambda v, at: F.product(v), times, lambda a, b: F.coalesce(a * b, a, b))


def least(value: Column) -> State:
    low = lambda v, w: F.min(v).over(w)
    return State(value, low, lambda v, at: F.min(v), low, lambda a, b: F.least(a, b))


def largest(value: Column) -> State:
    high = lambda v, w: F.max(v).over(w)
    return State(value, high, lambda v, at: F.max(v), high, lambda a, b: F.greatest(a, b))


def running(parts: Parts, states: dict[str, State], before: bool = False) -> DataFrame:
    """Adds each state over the rows from the group's first to this one, or to the one before. The rows keep _part.

    Where groups have several parts df is planned twice, for the parts' own states and for the rows.
    """
    frame = parts.window().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    d = parts.df.select("*", *[s.value.alias(f"_v_{n}") for n, s in states.items()])
    values = {n: F.col(f"_v_{n}") for n in states}
    own = d.select("*", *[s.over(values[n], frame).alias(f"_o_{n}") for n, s in states.items()])
    if parts.split:
        at = F.struct(*parts.order)
        sums = d.groupBy(*parts.by, "_part").agg(*[s.whole(values[n], at).alias(n) for n, s in states.items()])
        earlier = Window.partitionBy(*parts.by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        first = F.row_number().over(Window.partitionBy(*parts.by).orderBy("_part")) == 1
        carried = sums.select(*parts.by, "_part", first.alias("_first"), *[s.merge(F.col(n), earlier).alias(f"_b_{n}") for n, s in states.items()])
        carried = cut(carried.filter(~F.col("_first")).drop("_first"))  # nothing is known before a group's first part
        own = join_null_safe(own, carried, (*parts.by, "_part"))
        found = {n: s.join(F.col(f"_b_{n}"), F.col(f"_o_{n}")) for n, s in states.items()}
    else:
        found = {n: F.col(f"_o_{n}") for n in states}
    return own.select(*parts.df.columns, *[s.end(found[n]).alias(n) for n, s in states.items()])


def rolling(df: DataFrame, make: Callable[[WindowSpec], dict[str, Column]], before: int, after: int = 0, by: tuple[str, ...] = ("asset",), i: str = "i", rows: int = BLOCK) -> DataFrame:
    """Adds columns over windows that reach so many rows back and ahead; make gets the window they are to be made of.

    Groups are dense, their rows numbered by i from 0. Each is cut into blocks of rows; a row is sent to its own block and
    to those next to it that look at it, as one of their halo.
    """
    block = lambda x: F.floor(x / rows).cast("long")
    d = df.withColumn("_block", F.explode(F.sequence(block(F.greatest(F.col(i) - after, F.lit(0))), block(F.col(i) + before))))
    made = make(Window.partitionBy(*by, "_block").orderBy(i))
    d = d.select("*", *[c.alias(n) for n, c in made.items()])
    return d.filter(F.col("_block") == block(F.col(i))).drop("_block")

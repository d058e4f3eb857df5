"""Dependency tables as graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.sources.storage import cut

#: Rounds after which what is placed so far is written anew, so that plans stay short.
REWRITE = 20
#: Rows that a task gets, about.
ROWS = 500_000
CIRCLE = "tasks depend on each other in a circle"


def edges(tasks: DataFrame, separator: str = ",") -> DataFrame:
    """(task, depends_on) of tasks with a separated list of names; duplicate tasks and unknown names raise."""
    known, n = tasks.select("task"), tasks.count()
    if not spread(known, n, "task").groupBy("task").count().filter("count > 1").isEmpty():
        raise ValueError("a task stands twice")
    names = F.transform(F.split(F.coalesce("depends_on", F.lit("")), separator), lambda x: F.trim(x))
    e = tasks.select("task", F.explode(F.array_distinct(F.filter(names, lambda x: x != ""))).alias("depends_on"))
    known = spread(known.withColumnRenamed("task", "depends_on"), n, "depends_on").hint("merge")
    if not e.select("depends_on").distinct().join(known, "depends_on", "left_anti").isEmpty():
        raise ValueError("a task depends on an unknown one")
    return e


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Dealt out by keys, so that of n rows a task gets about ROWS; no more than that are left to Spark.

    Spark merges partitions by their compressed bytes, which for names are few; it does not merge these.
    """
    return df if n <= ROWS else df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)), *keys)


def impact(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """(task, affects): what a change of each task reaches, itself included; a circle raises.

    The length of paths doubles in each round. Known are all pairs at most 2^k edges apart; a round puts those exactly so
    far apart (last) in front of all. A pair is last in turn if it is new and found from two that are last alone. It ends
    when there is nothing to put together.
    """
    e = e.select(F.col("depends_on").alias("task"), F.col("task").alias("affects"))
    paths = cut(spread(e, e.count(), "task", "affects").distinct().withColumn("last", F.lit(True)))
    while True:
        ends = cut(_ends(paths))
        n_paths, n_longer, n_circles = ends.agg(F.sum("leave"), F.sum(F.col("arrive") * F.col("leave")), F.sum("circles")).first()
        if n_circles:
            raise ValueError(CIRCLE)
        if not n_longer:
            break
        found = paths.withColumn("last", F.lit(False)).unionByName(_longer(paths, ends, n_paths + n_longer))
        paths = cut(spread(found, n_paths + n_longer, "task", "affects").groupBy("task", "affects").agg(F.min("last").alias("last")))
    own = nodes.select("task", F.col("task").alias("affects"))
    return spread(own, nodes.count(), "task").distinct().unionByName(paths.drop("last"))


def _ends(paths: DataFrame) -> DataFrame:
    """(over, arrive, leave, circles): of each node, how many last paths end there, how many paths start there and come back."""
    row = lambda node, arrive, leave, circle: F.struct(F.col(node).alias("over"), arrive.cast("long").alias("arrive"), F.lit(leave).cast("long").alias("leave"), circle.cast("long").alias("circles"))
    both = F.array(row("task", F.lit(0), 1, F.coalesce(F.col("task") == F.col("affects"), F.lit(False))), row("affects", F.col("last"), 0, F.lit(0)))
    rows = paths.select(F.inline(both)).filter("arrive > 0 or leave > 0")
    return rows.groupBy("over").agg(*[F.sum(c).alias(c) for c in ("arrive", "leave", "circles")])


def _longer(paths: DataFrame, ends: DataFrame, n: int) -> DataFrame:
    """(task, affects, last): last paths with all that go on where they end, n rows at most with those joined.

    Where more than ROWS meet in a node, the longer side is dealt out over parts and the other goes to each of them. Such
    nodes are sent to all executors, one at most for every ROWS of the result.
    """
    meet = F.col("arrive") * F.col("leave")
    busy = F.broadcast(ends.filter(meet > ROWS).select("over", F.ceil(meet / ROWS).alias("parts"), (F.col("arrive") > F.col("leave")).alias("cut_first")))
    one_of = lambda c: F.array(F.pmod(F.xxhash64(c), F.col("parts")))
    each, only = F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), F.array(F.lit(0).cast("long"))
    part = lambda cut_here, c: F.explode(F.when(F.col("parts").isNull(), only).when(cut_here, one_of(c)).otherwise(each)).alias("part")
    first = paths.filter("last").select("task", F.col("affects").alias("over")).join(busy, "over", "left").select("task", "over", part(F.col("cut_first"), "task"))
    then = paths.select(F.col("task").alias("over"), "affects", "last").join(busy, "over", "left").select("over", "affects", "last", part(~F.col("cut_first"), "affects"))
    first, then = (spread(x, n, "over", "part").hint("merge") for x in (first, then))
    return then.join(first, ["over", "part"]).select("task", "affects", "last")


def longest(nodes: DataFrame, e: DataFrame, scope: tuple[str, ...] = (), name: str = "task", ref: str = "depends_on") -> DataFrame:
    """(scope, name, level) of nodes that no circle leads to: 0, or one more than the highest of those that it depends on.

    Nodes with one dependency form chains. Each is followed to its end by pointer doubling, in as many rounds as the
    longest has binary digits; who is not at an end by then is in a circle. Of the others, a node is placed once all
    that it depends on, over chains, is placed; that goes on until a round places none. Nothing bounds a chain's length.
    Edges are (scope, name, ref); both ends are nodes.
    """
    keys, up, to = [*scope, name], [*scope, ref], [*scope, "to"]
    e = cut(e.select(*keys, ref).distinct())
    n_refs = cut(e.groupBy(*keys).agg(F.count(F.lit(1)).alias("open"), F.min(ref).alias("to")))
    chain = cut(n_refs.filter("open = 1").select(*keys, "to", F.lit(1).cast("long").alias("steps")))
    n_chain, reach = chain.count(), 1
    while True:
        ahead = chain.select(*scope, F.col(name).alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        jumped = chain.join(ahead, to, "left").select(*keys, F.coalesce("to2", "to").alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("to2").isNotNull().alias("on"))
        jumped, reach = cut(jumped), 2 * reach
        chain = jumped.select(*keys, "to", "steps")
        if reach > n_chain or jumped.filter("on").isEmpty():
            break
    chain = cut(chain.join(chain.select(*scope, F.col(name).alias("to")), to, "left_anti"))

    over = chain.select(*scope, F.col(name).alias(ref), "to", "steps")
    many = n_refs.filter("open > 1").select(*keys)
    e = e.join(many, keys, "left_semi").join(over, up, "left")
    e = cut(e.select(*keys, F.coalesce("to", ref).alias(ref), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")))
    waiting = cut(n_refs.filter("open > 1").select(*keys, "open", F.lit(0).cast("long").alias("level")))
    placed = cut(nodes.select(*keys).distinct().join(n_refs, keys, "left_anti").select(*keys, F.lit(0).cast("long").alias("level")))
    out, n = placed, 0
    while not placed.isEmpty() and not waiting.isEmpty():
        below = placed.select(*scope, F.col(name).alias(ref), F.col("level").alias("below"))
        done = e.join(below, up).groupBy(*keys).agg(F.count(F.lit(1)).alias("done"), F.max(F.col("below") + F.col("steps")).alias("new"))
        waiting = cut(waiting.join(done, keys, "left").select(*keys, (F.col("open") - F.coalesce("done", F.lit(0))).alias("open"), F.greatest("level", F.coalesce("new", F.lit(0))).alias("level")))
        placed, waiting = waiting.filter("open = 0").select(*keys, "level"), waiting.filter("open > 0")
        out, n = out.unionByName(placed), n + 1
        out = cut(out) if n % REWRITE == 0 else out
    ends = out.select(*scope, F.col(name).alias("to"), "level")
    chained = chain.join(ends, to).select(*keys, (F.col("level") + F.col("steps")).alias("level"))
    return out.unionByName(chained)


def levels(nodes: DataFrame, e: DataFrame) -> DataFrame:
    """(task, level): the longest chain of dependencies below each task; in order of (level, task), dependencies come first. A circle raises."""
    out = cut(longest(nodes, e))
    if not nodes.select("task").join(out, "task", "left_anti").isEmpty():
        raise ValueError(CIRCLE)
    return out


def violations(order: DataFrame, e: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(task, depends_on) whose dependency, or a member of its group, does not stand before the task. order: (task, position)."""
    at = order.select(F.col("task").alias("member"), F.col("position").alias("there"))
    if groups is None:
        stands = at.select(F.col("member").alias("depends_on"), "there")
    else:
        g = groups.select("task", "group_no")
        mates = g.select(F.col("task").alias("depends_on"), "group_no").join(g.select(F.col("task").alias("member"), "group_no"), "group_no").select("depends_on", "member")
        own = order.select(F.col("task").alias("depends_on"), F.col("task").alias("member"))
        stands = mates.unionByName(own).distinct().join(at, "member").groupBy("depends_on").agg(F.min("there").alias("there"))
    d = e.join(order, "task").join(stands, "depends_on", "left")
    return d.filter(F.col("there").isNull() | (F.col("there") >= F.col("position"))).select("task", "depends_on")

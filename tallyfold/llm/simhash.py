"""Near duplicates by SimHash, joined with themselves as a binary trie.

Fingerprints are the leaves of a trie over their bits. The join walks pairs of nodes together, adds up the bits in
which they differ and drops a pair once it exceeds the error budget. As at least one of four quarters of two linked
fingerprints is equal, the walk is started four times, with each quarter in turn at the top, at the nodes below it:
these nodes are what Spark deals out. A node with very many leaves is dealt out as pairs of deeper nodes.

Only links that join what was apart are kept, so that a dense group of n fingerprints gives n - 1 links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import cut, map_texts, row_key, same_key, space_words
from tallyfold.llm.components import components

SHINGLE, BUDGET, SEED = 3, 3, 42
#: Leaves that one dealt-out node pair has at most; beyond, it is split STEP bits further down.
CAP, STEP = 20_000, 8
#: Deals: the lengths of a fingerprint's parts, how many of them are equal in linked ones, and the bits they have at least.
FEW, MANY = ((16, 16, 16, 16), 1, 16), ((11, 11, 11, 11, 10, 10), 3, 31)
#: Leaves that a task walks at once, and node pairs that a walk holds.
CHUNK, FRONTIER = 100_000, 1_000_000
#: Node pairs with so few leaf pairs are compared directly.
DIRECT = 8


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> int:
    """Bit by bit the majority of the shingles' hashes; 0 without words. A tie gives 0."""
    if not words:
        return 0
    joined, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = list(zip(starts, ends[shingle - 1 :], strict=False)) if len(words) >= shingle else [(0, len(joined))]
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(spans), 1 << 15):
        part = np.array([hashed(joined[a:b], SEED) for a, b in spans[k : k + (1 << 15)]], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans)).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, fp): the row's key, and fp as a signed 64-bit integer; 0 for null and for texts without words. One row per row."""

    def make() -> Callable[[list], dict]:
        return lambda texts: {"fp": pa.array(np.array([fingerprint(space_words(t), shingle) for t in texts], dtype=np.uint64).view(np.int64), pa.int64())}

    return map_texts(docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")), make, "fp bigint", "_id", "text", keep=["_hash"])


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after linking a[i] with b[i], and which of the links were needed."""
    used = np.zeros(len(a), dtype=bool)
    label = label.copy()
    while True:
        x, y = label[a], label[b]
        apart = np.flatnonzero(x != y)
        if not len(apart):
            return label, used
        lo, hi = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        # One link for each larger label: it is hung under a smaller one, so no circle can close.
        tops, first = np.unique(hi, return_index=True)
        used[apart[first]] = True
        parent = np.arange(len(label))
        parent[tops] = lo[first]
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        label = parent[label]


def walk(values: np.ndarray, pairs: np.ndarray, budget: int, runs: np.ndarray, label: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs at most budget bits apart from pairs of trie nodes at depth top.

    values: sorted within each node; pairs: rows (lo1, hi1, lo2, hi2) of ranges of values, equal ranges for a node
    with itself. Node pairs whose leaves all have one label are skipped: runs numbers stretches of equal labels.
    """
    found: list[np.ndarray] = []
    stack = [(top, pairs, np.zeros(len(pairs), dtype=np.int8))]
    sums: dict[int, np.ndarray] = {}
    while stack:
        depth, p, err = stack.pop()
        if len(p) > FRONTIER:
            half = len(p) // 2
            stack += [(depth, p[half:], err[half:]), (depth, p[:half], err[:half])]
            continue
        lo1, hi1, lo2, hi2 = p.T
        same = lo1 == lo2
        n1, n2 = hi1 - lo1, hi2 - lo2
        one = (runs[lo1] == runs[hi1 - 1]) & (runs[lo2] == runs[hi2 - 1]) & (label[lo1] == label[lo2])
        few = ~one & ((n1 * n2 <= DIRECT) | (depth >= 64))
        if few.any():
            found.append(_compare(values, lo1[few], n1[few], lo2[few], n2[few], budget))
        go = ~one & ~few
        if depth >= 64 or not go.any():
            continue
        lo1, hi1, lo2, hi2, err, same = lo1[go], hi1[go], lo2[go], hi2[go], err[go], same[go]
        if depth not in sums:
            sums[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        ones = sums[depth]
        m1, m2 = hi1 - (ones[hi1] - ones[lo1]), hi2 - (ones[hi2] - ones[lo2])
        parts = [(lo1, m1, lo2, m2, err), (m1, hi1, m2, hi2, err), (lo1, m1, m2, hi2, err + 1), (m1, hi1, lo2, m2, err + 1)]
        keep = [(a < b) & (c < d) & (e <= budget) for a, b, c, d, e in parts]
        keep[3] &= ~same
        new = np.concatenate([np.stack(x[:4], axis=1)[k] for x, k in zip(parts, keep, strict=True)])
        if len(new):
            stack.append((depth + 1, new, np.concatenate([x[4][k] for x, k in zip(parts, keep, strict=True)])))
    both = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    return both[:, 0], both[:, 1]


def _compare(values: np.ndarray, lo1: np.ndarray, n1: np.ndarray, lo2: np.ndarray, n2: np.ndarray, budget: int) -> np.ndarray:
    out = []
    size = n1 * n2
    step = max(1, 4 * FRONTIER // max(int(size.max()), 1))
    for k in range(0, len(size), step):
        s = size[k : k + step]
        which = np.repeat(np.arange(k, k + len(s)), s)
        at = np.arange(len(which)) - np.repeat(np.cumsum(s) - s, s)
        i, j = lo1[which] + at // n2[which], lo2[which] + at % n2[which]
        near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
        out.append(np.stack([i[near], j[near]], axis=1))
    return np.concatenate(out)


def links_of(values: np.ndarray, pairs: np.ndarray, budget: int, top: int) -> tuple[np.ndarray, np.ndarray]:
    """As walk, but only links that join what was apart. Small budgets come first: what they join need not be walked again."""
    label = np.arange(len(values))
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for b in range(1, budget + 1):
        runs = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])]) if len(label) else label
        i, j = walk(values, pairs, b, runs, label, top)
        label, used = joined(label, i, j)
        out.append((i[used], j[used]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _walk_groups(batches: Iterator[pa.RecordBatch], budget: int, top: int) -> Iterator[pa.RecordBatch]:
    """Rows (q, x, y, side, v, rep), sorted; a group is one (q, x, y). Links as (a, b) of rep."""

    def links(t: pa.Table) -> pa.RecordBatch:
        q, x, y, side, v = (t.column(c).to_numpy() for c in ("q", "x", "y", "side", "v"))
        v, rep = v.view(np.uint64), t.column("rep").to_numpy()
        new = np.flatnonzero((q[1:] != q[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
        lo, hi = np.concatenate([[0], new]), np.concatenate([new, [len(q)]])
        ones = np.concatenate([[0], np.cumsum(side)])
        mid = hi - (ones[hi] - ones[lo])
        own = x[lo] == y[lo]
        pairs = np.stack([lo, np.where(own, hi, mid), np.where(own, lo, mid), hi], axis=1)
        pairs = pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3])]
        i, j = links_of(v, pairs.astype(np.int64), budget, top)
        return pa.RecordBatch.from_arrays([pa.array(rep[i]), pa.array(rep[j])], names=["a", "b"])

    held: list[pa.Table] = []
    for b in batches:
        held.append(pa.Table.from_batches([b]))
        if sum(map(len, held)) >= CHUNK:
            t = pa.concat_tables(held).combine_chunks()
            k = np.stack([t.column(c).to_numpy() for c in ("q", "x", "y")])
            new = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0))
            if len(new):  # the last group may go on
                yield links(t.slice(0, int(new[-1]) + 1))
                t = t.slice(int(new[-1]) + 1)
            held = [t]
    if sum(map(len, held)):
        yield links(pa.concat_tables(held).combine_chunks())


def _turned(parts: tuple[int, ...], chosen: tuple[int, ...]) -> Column:
    """The fingerprint with the chosen parts first."""
    starts = [0, *accumulate(parts)]
    out, shift = F.lit(0).cast("long"), 64
    for k in [*chosen, *(k for k in range(len(parts)) if k not in chosen)]:
        shift -= parts[k]
        part = F.shiftrightunsigned("fp", 64 - starts[k + 1]).bitwiseAND(F.lit((1 << parts[k]) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, shift))
    return out


def near_links(leaves: DataFrame, budget: int = BUDGET, cap: int = CAP, deal: tuple | None = None) -> DataFrame:
    """From distinct (fp, rep) to links (a, b) of rep that connect all fingerprints at most budget (0 to 3) bits apart.

    The deal follows from the number of leaves: FEW while its nodes hold cap leaves on average at most. Both give the same components.
    """
    if not 0 <= budget <= 3:
        raise ValueError("the parts bear at most three errors")
    parts, equal, top = deal or (FEW if leaves.count() <= cap << FEW[2] else MANY)
    turned = F.array(*[F.struct(F.lit(q).alias("q"), _turned(parts, c).alias("v")) for q, c in enumerate(combinations(range(len(parts)), equal))])
    rows = leaves.select(F.explode(turned).alias("t"), "rep").select("t.q", "t.v", "rep")
    prefix = F.shiftrightunsigned("v", 64 - top)
    rows = rows.select("q", prefix.alias("x"), prefix.alias("y"), F.lit(0).alias("side"), "v", "rep")
    depth, done = top, None
    while depth + STEP <= 64:
        sizes = rows.groupBy("q", "x", "y").agg(F.count(F.lit(1)).alias("n"), F.max("side").alias("hi"), F.min("side").alias("lo"))
        heavy = cut(sizes.filter((F.col("n") > cap) & ((F.col("x") == F.col("y")) | (F.col("hi") != F.col("lo")))).select("q", "x", "y"))
        if heavy.isEmpty():
            break
        light = rows.join(heavy, ["q", "x", "y"], "left_anti")
        done = light if done is None else done.unionByName(light)
        depth += STEP
        own = F.shiftrightunsigned("v", 64 - depth)
        masks = F.array(*[F.lit(m).cast("long") for m in range(1 << STEP) if m.bit_count() <= budget])
        split = rows.join(heavy, ["q", "x", "y"], "left_semi").select("*", own.alias("own"), F.explode(masks).alias("m"))
        # The partner node: the other one's prefix, with own next bits changed by the mask.
        other = F.when(F.col("side") == 0, F.col("y")).otherwise(F.col("x"))
        partner = F.shiftleft(other, STEP).bitwiseOR(F.col("own").bitwiseAND(F.lit((1 << STEP) - 1).cast("long")).bitwiseXOR(F.col("m")))
        near = F.bit_count(F.col("own").bitwiseXOR(partner)) <= budget
        left = F.least("own", "partner").alias("x")
        split = split.select("*", partner.alias("partner"), near.alias("near")).filter("near")
        split = split.select("q", left, F.greatest("own", "partner").alias("y"), (F.col("own") > F.col("partner")).cast("int").alias("side"), "v", "rep")
        rows = cut(split)
    rows = rows if done is None else done.unionByName(rows)
    dealt = rows.repartition("q", "x", "y").sortWithinPartitions("q", "x", "y", "side", F.expr("v ^ (-9223372036854775808L)"))
    return dealt.mapInArrow(lambda batches: _walk_groups(batches, budget, top), "a bigint, b bigint")


def grouped(docs: DataFrame, shingle: int, budget: int, cap: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, fp, first): for every row its key, and the smallest key of its component as (none, id, hash); null ids come last.

    Fingerprints are linked, not ids, which may be null or stand on several texts.
    """
    own = cut(fingerprints(docs.withColumn(id_col, F.col(id_col).cast("long")), shingle, id_col, text_col))
    key = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_hash").alias("hash"))
    leaves = cut(own.groupBy("fp").agg(F.min(key).alias("first")))
    found = components(near_links(leaves.select("fp", F.col("fp").alias("rep")), budget, cap)).select(F.col("id").alias("fp"), "component")
    linked = cut(leaves.join(found, "fp"))
    least = cut(linked.groupBy("component").agg(F.min("first").alias("least")))
    # Dealt anew, though it lies by component already: only then can Spark split the many fingerprints of one component.
    least = least.select(F.negative(F.negative("component")).alias("component"), "least")
    least = linked.select("fp", "component").join(least, "component").select("fp", "least")
    named = cut(leaves.join(least, "fp", "left").select("fp", F.coalesce("least", "first").alias("first")))
    return own.join(named.select(F.negative(F.negative("fp")).alias("fp"), "first"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, budget: int = BUDGET, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, fingerprint (16 hex digits) and component_id: the smallest id reachable over links, itself included.

    Ids are integers. Fingerprints at most budget bits apart are linked; so are all texts without words, whose
    fingerprint is zero, and null texts. One row per row; a row without an id gets the smallest id of its component.
    """
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return grouped(docs, shingle, budget, cap, id_col, text_col).select(F.col("_id").alias(id_col), digits, F.col("first.id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each group: that with the smallest id, null last, and of several texts with it the smallest hash."""
    found = cut(grouped(docs, SHINGLE, BUDGET, CAP, id_col, text_col))
    first = F.col("_id").eqNullSafe(F.col("first.id")) & (F.col("_hash") == F.col("first.hash"))
    left = same_key(docs, cut(found.filter(~first).select("_id", "_hash").distinct()), id_col, text_col, "left_anti")
    twice = cut(found.filter(first).groupBy("_id", "_hash").count().filter("count > 1").select("_id", "_hash"))
    if twice.isEmpty():
        return left
    again = same_key(left, twice, id_col, text_col, "left_semi").select(F.struct("*").alias("row"), *row_key(id_col, text_col)).dropDuplicates(["_id", "_hash"])
    return same_key(left, twice, id_col, text_col, "left_anti").unionByName(again.select("row.*"))

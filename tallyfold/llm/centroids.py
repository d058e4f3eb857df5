"""Centroid clustering (Lloyd's rounds) in exact integers, by dual trees.

Vectors are put into blocks, each with a cover tree that is built once and kept. In each round a task walks its blocks'
trees together with a tree of the centroids, and gives counts and sums for each centroid; their totals, a row for each
centroid, are all that comes to the driver. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import cut, ship
from tallyfold.llm.dual_tree import Tree, cover_tree, nearest

K, DIMS, ROUNDS, SCALE, SEED = 40, 64, 5, 256, "2"
#: Vectors of one tree.
BLOCK = 1024
#: Larger components fail the job: squared distances would not fit 64 bits.
LARGEST = 1 << 26
_TREE = ", ".join(f"{f} binary" for f in Tree.FIELDS)


def scaled(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): the vectors with dims components, none null or non-finite, as integers floor(scale * x)."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda e: F.coalesce(F.abs(e.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(e.cast("double")))
    big = F.raise_error(F.lit(f"a component beyond {LARGEST}")).cast("long")
    whole = F.transform(x, lambda e: F.when(F.abs(e.cast("double") * scale) <= LARGEST, F.floor(e.cast("double") * scale)).otherwise(big).cast("int"))
    return vectors.filter(x.isNotNull() & (F.size(x) == dims) & fine).select(F.col(id_col).alias("id"), whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int = K, seed: str = SEED) -> np.ndarray:
    """k vectors at most: those whose id with the seed has the smallest sha256, equal ones by their components. A null id is as an empty one."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(place.alias("at"), "v").orderBy("at", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """(ids, vectors, and the arrays of a tree): vectors as 32-bit integers, with their ids in the order of the tree."""
    ship(vectors.sparkSession)
    kind = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def rows(last: bool) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            done = len(t) if last else len(t) // block * block
            for lo in range(0, done, block):
                part = t.slice(lo, min(block, done - lo))
                v = part.column("v").combine_chunks()
                x = v.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(len(part), -1)
                tree = cover_tree(x)
                ids = part.column("id").take(pa.array(tree.order)).combine_chunks()
                parts = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x[tree.order].tobytes()], pa.binary())]
                parts += [pa.array([a.tobytes()], pa.binary()) for a in tree.arrays()]
                yield pa.RecordBatch.from_arrays(parts, names=["ids", "vectors", *Tree.FIELDS])
            held[:] = t.slice(done).to_batches()

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= block:
                yield from rows(False)
        if sum(map(len, held)):
            yield from rows(True)

    return vectors.mapInArrow(run, f"ids array<{kind}>, vectors binary, {_TREE}")


def _read(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, Tree]]:
    column = lambda c, i: b.column(b.schema.get_field_index(c))[i]
    for i in range(len(b)):
        arrays = [np.frombuffer(column(f, i).as_py(), float if f == "radius" else np.int64) for f in Tree.FIELDS]
        ids = column("ids", i).values
        yield ids, np.frombuffer(column("vectors", i).as_py(), np.int32).reshape(len(ids), -1), Tree(*arrays)


def sums(made: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(cluster, n, sums): of the vectors nearest to each centroid, summed up by each task before they are shuffled."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ct = cover_tree(centroids, 1)
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for b in batches:
            for _, x, t in _read(b):
                best, _ = nearest(x, t, centroids, ct)
                n += np.bincount(best, minlength=k)
                order = np.argsort(best, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(best[order]) > 0]))
                total[best[order[starts]]] += np.add.reduceat(x[order].astype(np.int64), starts)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    parts = made.mapInArrow(run, "cluster bigint, n bigint, sums array<bigint>")
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(j))) for j in range(dims)]).alias("sums"))


def assigned(made: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(id, cluster, distance) of every vector; the distance is squared."""
    kind = made.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ct = cover_tree(centroids, 1)
        for b in batches:
            for ids, x, t in _read(b):
                best, far = nearest(x, t, centroids, ct)
                yield pa.RecordBatch.from_arrays([ids, pa.array(best.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    return made.mapInArrow(run, f"id {kind}, cluster int, distance bigint")


def lloyd(made: DataFrame, centroids: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids after so many rounds: each becomes floor(sum / count) of its vectors, or stays where it has none."""
    for _ in range(rounds):
        new = centroids.copy()
        for r in sums(made, centroids).collect():  # a row for each centroid
            new[r["cluster"]] = [s // r["n"] for s in r["sums"]]
        centroids = new
    return centroids


def cluster(vectors: DataFrame, k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: str = SEED, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The id column, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256; one row for each vector that is kept.

    Kept are vectors of dims components, none null or non-finite. Ids may be null or repeat. Fewer than k vectors give as
    many clusters; no vector gives no row. centroid_sha256 is that of the components as decimals, joined by commas.
    """
    kept = scaled(vectors, dims, scale, id_col, vector_col)
    start = first_centroids(kept, k, seed)
    spark, given = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    if not len(start):
        return spark.createDataFrame([], f"`{id_col}` {given}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    made = cut(blocks(kept))
    centroids = lloyd(made, start, rounds)
    d = cut(assigned(made, centroids))
    total = d.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    named = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    total = total.join(F.broadcast(spark.createDataFrame(named, "cluster int, centroid_sha256 string")), "cluster")
    whole = total.agg(F.sum("cluster_inertia").alias("inertia"))
    total = total.crossJoin(F.broadcast(whole))  # k rows
    return d.join(F.broadcast(total), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

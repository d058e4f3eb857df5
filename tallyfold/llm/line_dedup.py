"""Lines that many documents hold, dropped in all of them; documents can be added to the index and taken out again.

The index has an exact table of references, (hi, lo, n): for each line's digest how many documents hold it; and, derived
from it, sharded cuckoo filters of the lines that reach the threshold. Putting documents in or out changes counts;
lines that cross the threshold enter or leave their shard's filter. Documents are asked against the filters, which
travel to all executors; what they suspect wrongly is found in the exact table, by digests alone, and left out.

Lines are told apart by 128-bit digests (XXH3): of a trillion different lines two share one with a chance of 2e-15.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import cuckoo
from tallyfold.llm.base import BROADCAST_BYTES, LOWER_BYTES, bounded_batches, cut, fits, map_texts, row_key, ship

THRESHOLD, MIN_CHARS = 10, 1
BLANKS = b" \t\n\x0b\x0c\r"
#: The lines of most documents, at most so many, are joined apart: no other line is in more than its part of all lines.
HOT = 100_000


@dataclass(frozen=True)
class Index:
    """refs (hi, lo, n); filters (shard, table, stash); bits of hi that name the shard; and the parameters."""

    refs: DataFrame
    filters: DataFrame
    bits: int
    threshold: int = THRESHOLD
    min_chars: int = MIN_CHARS

    def often(self) -> DataFrame:
        return self.refs.filter(F.col("n") >= self.threshold)


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).translate(LOWER_BYTES)


def digests(lines: list[bytes], min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, whether the key is long enough) of a text's lines."""
    keys = [line_key(x) for x in lines]
    raw = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").astype(np.uint64).reshape(-1, 2)
    # Code points are the bytes that don't go on with another one.
    long = [len(k) >= min_chars if min_chars <= 1 else sum((b & 0xC0) != 0x80 for b in k) >= min_chars for k in keys]
    return raw[:, 0], raw[:, 1], np.array(long, dtype=bool)


def lines_of(text: str | None) -> list[bytes]:
    """Split at line feeds; null and empty are one empty line."""
    return (text or "").encode("utf-8", "replace").split(b"\n")


def _distinct(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of (hi, lo), and how often each is there."""
    rows = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.uint64)
    order = np.lexsort((rows[:, 1], rows[:, 0]))
    rows = rows[order]
    starts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])) if len(rows) else np.zeros(0, np.int64)
    return rows[starts], np.diff(np.concatenate([starts, [len(rows)]]))


def _counted(docs: DataFrame, min_chars: int, text_col: str, make: Callable[[], Callable[[np.ndarray, np.ndarray], np.ndarray] | None]) -> DataFrame:
    """(hi, lo, n): the digests of long enough lines, and in how many rows they are; only those that the made function picks."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = make()
        for b in batches:
            found = []
            for text in b.column(0).to_pylist():
                hi, lo, long = digests(lines_of(text), min_chars)
                long = long & pick(hi, lo) if pick else long
                found.append(_distinct([np.stack([hi[long], lo[long]], axis=1)])[0])
            rows, n = _distinct(found)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0].view(np.int64)), pa.array(rows[:, 1].view(np.int64)), pa.array(n.astype(np.int64))], names=["hi", "lo", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "hi bigint, lo bigint, n bigint")
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"))


def _filtered(changes: DataFrame, filters: DataFrame | None, bits: int) -> DataFrame:
    """Filters (shard, table, stash) after changes (hi, lo, up): each shard's changes are put into its own filter, in a task for each shard."""
    shard = (F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0).cast("long")).cast("int").alias("shard")
    changes = changes.select(shard, "hi", "lo", "up")
    ship(changes.sparkSession)
    if filters is None:
        filters = changes.sparkSession.createDataFrame([], "shard int, table binary, stash binary")

    def put(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        s = cuckoo.Shard(*(old[["table", "stash"]].iloc[0] if len(old) else ()))
        fp, bucket = cuckoo.prints(new["hi"].to_numpy(np.int64).view(np.uint64), new["lo"].to_numpy(np.int64).view(np.uint64))
        up = new["up"].to_numpy(bool)
        s.take(fp[~up], bucket[~up])
        s.add(fp[up], bucket[up])
        number = int((old if len(old) else new)["shard"].iloc[0])
        return pd.DataFrame({"shard": [number], "table": [s.table.tobytes()], "stash": [s.stash.tobytes()]})

    return filters.groupBy("shard").cogroup(changes.groupBy("shard")).applyInPandas(put, "shard int, table binary, stash binary")


def empty(spark: SparkSession, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> Index:
    """An index of no documents."""
    refs = spark.createDataFrame([], "hi long, lo long, n long")
    return Index(refs, spark.createDataFrame([], "shard int, table binary, stash binary"), 0, threshold, min_chars)


def _changed(index: Index, docs: DataFrame, sign: int, text_col: str, shard_keys: int) -> Index:
    new = _counted(docs, index.min_chars, text_col, lambda: None).select("hi", "lo", F.lit(0).cast("long").alias("was"), (F.col("n") * sign).alias("change"))
    old = index.refs.select("hi", "lo", F.col("n").alias("was"), F.lit(0).cast("long").alias("change"))
    n = F.sum("was") + F.sum("change")
    wrong = F.raise_error(F.lit("a line is taken out that was never put in")).cast("long")
    both = cut(old.unionByName(new).groupBy("hi", "lo").agg(F.sum("was").alias("was"), F.when(n >= 0, n).otherwise(wrong).alias("n")))
    refs = both.filter("n > 0").select("hi", "lo", "n")
    often = refs.filter(F.col("n") >= index.threshold)
    bits = cuckoo.shard_bits(often.count(), shard_keys)
    if bits > index.bits:  # shards would get too full: all anew, with more of them
        return replace(index, refs=refs, bits=bits, filters=cut(_filtered(often.select("hi", "lo", F.lit(True).alias("up")), None, bits)))
    up = F.col("n") >= index.threshold
    crossed = both.filter(up != (F.col("was") >= index.threshold)).select("hi", "lo", up.alias("up"))
    return replace(index, refs=refs, filters=cut(_filtered(crossed, index.filters, index.bits)))


def insert(index: Index, docs: DataFrame, text_col: str = "text", shard_keys: int = cuckoo.SHARD_KEYS) -> Index:
    """The index with more documents; each row is one."""
    return _changed(index, docs, 1, text_col, shard_keys)


def delete(index: Index, docs: DataFrame, text_col: str = "text", shard_keys: int = cuckoo.SHARD_KEYS) -> Index:
    """The index without documents that were put in; a line that was not fails the job. It then is as if they never had been there."""
    return _changed(index, docs, -1, text_col, shard_keys)


def save(index: Index, folder: str) -> None:
    """Written to a new folder."""
    index.refs.write.parquet(f"{folder}/refs")
    index.filters.write.parquet(f"{folder}/filters")
    index.refs.sparkSession.createDataFrame([(index.bits, index.threshold, index.min_chars)], "bits int, threshold int, min_chars int").write.parquet(f"{folder}/parameters")


def load(spark: SparkSession, folder: str) -> Index:
    bits, threshold, min_chars = spark.read.parquet(f"{folder}/parameters").first()
    return Index(spark.read.parquet(f"{folder}/refs"), spark.read.parquet(f"{folder}/filters"), bits, threshold, min_chars)


def drop_lines(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", limit: int = BROADCAST_BYTES) -> DataFrame:
    """The id column, n_lines (before dropping), n_dropped and kept, one row per row: the text without the lines that are in threshold documents of the index.

    The documents need not be in the index. Null and empty texts are one empty line. Filters of more than limit bytes
    are not sent around: lines then go to the exact table by shuffle.
    """
    if index.filters.limit(limit // cuckoo.SHARD_BYTES + 1).count() * cuckoo.SHARD_BYTES > limit:
        return by_join(docs, index, id_col, text_col)
    sc = docs.sparkSession.sparkContext
    asked = sc.broadcast(cuckoo.Filter(index.bits, [(r["shard"], bytes(r["table"]), bytes(r["stash"])) for r in index.filters.collect()]))
    min_chars = index.min_chars
    suspects = _counted(docs, min_chars, text_col, lambda: asked.value.has).select("hi", "lo")
    wrong = cut(suspects.join(index.often().select("hi", "lo"), ["hi", "lo"], "left_anti"))
    if not fits(wrong, 16, limit):
        return by_join(docs, index, id_col, text_col)
    # A few of every 10,000 lines that are not in the filter.
    innocent = sc.broadcast({(r["hi"], r["lo"]) for r in wrong.collect()})

    def make() -> Callable[[list], dict]:
        def work(texts: list) -> dict:
            n, dropped, kept = [], [], []
            for t in texts:
                lines = lines_of(t)
                hi, lo, long = digests(lines, min_chars)
                out = long & asked.value.has(hi, lo)
                if innocent.value:
                    at = np.flatnonzero(out)
                    out[at] = [x not in innocent.value for x in zip(hi[at].view(np.int64).tolist(), lo[at].view(np.int64).tolist(), strict=True)]
                n.append(len(lines))
                dropped.append(int(out.sum()))
                kept.append(b"\n".join([x for x, o in zip(lines, out.tolist(), strict=True) if not o]).decode())
            return {"n_lines": pa.array(n, pa.int64()), "n_dropped": pa.array(dropped, pa.int64()), "kept": pa.array(kept, pa.string())}

        return work

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_texts(rows, make, "n_lines bigint, n_dropped bigint, kept string", "id", "text").withColumnRenamed("id", id_col)


def by_join(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """As drop_lines, by joining all lines with the exact table.

    The hot lines, a bounded number, are joined by broadcast: no line of the others is in more than one of hot of all.
    """
    min_chars = index.min_chars
    line = pa.struct([("no", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64())])

    def make() -> Callable[[list], dict]:
        def work(texts: list) -> dict:
            found = []
            for t in texts:
                hi, lo, long = digests(lines_of(t), min_chars)
                at = np.flatnonzero(long)
                found.append([{"no": i, "hi": a, "lo": b} for i, a, b in zip(at.tolist(), hi[at].view(np.int64).tolist(), lo[at].view(np.int64).tolist(), strict=True)])
            return {"lines": pa.array(found, pa.list_(line))}

        return work

    rows = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).dropDuplicates(["_id", "_hash"])
    each = map_texts(rows, make, "lines array<struct<no:int,hi:bigint,lo:bigint>>", "_id", "text", keep=["_hash"]).select("_id", "_hash", F.inline("lines"))
    often = index.often().select("hi", "lo", "n")
    top = cut(often.orderBy(F.desc("n"), "hi", "lo").limit(hot).select("hi", "lo"))
    by_top, by_rest = each.join(F.broadcast(top), ["hi", "lo"], "left_semi"), each.join(F.broadcast(top), ["hi", "lo"], "left_anti").join(often.select("hi", "lo"), ["hi", "lo"], "left_semi")
    gone = cut(by_top.unionByName(by_rest).groupBy("_id", "_hash").agg(F.collect_list("no").alias("gone")))  # at most a text's lines
    own_id, own_hash = row_key(id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1).alias("lines"), own_id.alias("own_id"), own_hash.alias("own_hash"))
    d = rows.join(gone, F.col("own_id").eqNullSafe(F.col("_id")) & (F.col("own_hash") == F.col("_hash")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return d.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"), kept.alias("kept"))


def dedup(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As drop_lines, for the documents among themselves."""
    index = insert(empty(docs.sparkSession, threshold, min_chars), docs, text_col)
    return drop_lines(docs, index, id_col, text_col)

"""What the text operators share: bounded Arrow batches, per-document mapping, sized broadcasts, checkpoints."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.sources.storage import cut, ship, shared_folder as checkpoint_dir  # noqa: F401

#: Rows that one Arrow batch holds at most, so that a batch of long texts fits a Python worker.
BATCH_ROWS = 256

#: A table is handed to every executor only if it has at most this many bytes; beyond, a shuffle join is used.
BROADCAST_BYTES = 64 << 20

#: Byte table that lower-cases A-Z, keeps a-z, 0-9 and all bytes of non-ASCII characters, and blanks the rest.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)

#: Byte table that only lower-cases A-Z.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, as UTF-8; none for null."""
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


#: Words between ASCII white space only (bytes.split() splits at these six as well).
def space_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "replace").translate(LOWER_BYTES).split() if text else []


def bounded_batches(spark: SparkSession) -> None:
    """Lower the Arrow batch size of the session to BATCH_ROWS; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list], dict[str, pa.Array]]], schema: str, id_col: str, text_col: str, keep: list[str] | None = None) -> DataFrame:
    """Run a function over every text, a batch at a time.

    make: called once in each task; returns the function from a list of texts to the new columns.
    The result has the id column, the columns in keep and the new ones; other columns can't clash.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ship(spark)
    keep = [id_col, *(keep or [])]
    slim = docs.select(*[F.col(c) for c in dict.fromkeys([*keep, text_col])])
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for b in batches:
            new = work(b.column(b.schema.get_field_index(text_col)).to_pylist())
            arrays = [b.column(b.schema.get_field_index(c)) for c in keep] + list(new.values())
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *new])
        del work  # the worker lives on for other tasks: give back what this one held
        gc.collect()
        pa.default_memory_pool().release_unused()

    return slim.mapInArrow(run, ", ".join([*kept, schema]))


def fits(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, counted, stay under the limit at row_bytes each."""
    return df.limit(limit // row_bytes + 1).count() * row_bytes <= limit


#: Elements, and characters, of one block in running and text_blocks.
_RUN, _BLOCK = 256, 1024


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """0 and what joining the elements of an int array one by one gives: one element more than the array has.

    Done in blocks, whose own results are then put on top of each other, as an array can grow only by being copied.
    """
    last = lambda a: F.element_at(a, -1)
    grow = lambda x: F.aggregate(x, F.array(F.lit(0)), lambda a, v: F.concat(a, F.array(join(last(a), v))))
    blocks = lambda all_: F.transform(F.sequence(F.lit(0), ((F.size(all_) - 1) / _RUN).cast("int")), lambda b: grow(F.slice(all_, b * _RUN + 1, _RUN)))
    on_top = lambda own: let(grow(F.transform(own, last)), lambda base: F.flatten(F.transform(own, lambda x, b: F.transform(F.slice(x, 2, _RUN), lambda v: join(F.get(base, b), v)))))
    return let(values, lambda all_: F.when(F.size(all_) > 0, F.concat(F.array(F.lit(0)), let(blocks(all_), on_top))).otherwise(F.array(F.lit(0))))


def text_blocks(text: Column) -> Column:
    """The text in blocks of characters, for piece."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % _BLOCK), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end, 0-based and end exclusive, of a text in blocks: the time does not depend on where they stand."""
    first = (start / _BLOCK).cast("int")
    some = F.array_join(F.slice(blocks, first + 1, ((end - 1) / _BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(some, start - first * _BLOCK + 1, end - start)).otherwise("")


def where(df: DataFrame, condition) -> DataFrame:
    """Filter on computed columns as they are, without pushing the condition into what computes them.

    Pushed down, long expressions would be copied into the filter and worked out once more for each mention. A column
    that is not deterministic holds it back.
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).filter(condition & (F.col("_at") >= 0)).drop("_at")


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(_id, _hash), what tells rows apart where ids are null or repeat. Texts have 128 bits of hash, null has an empty one."""
    return [F.col(id_col).alias("_id"), F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("")).alias("_hash")]


def same_key(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """left_anti or left_semi join of docs with keys, which row_key made; they are sent to all executors only if they are small. docs may have any columns."""
    keys = keys.select(F.col("_id").alias("_key_id"), F.col("_hash").alias("_key_hash"))
    own_hash = F.coalesce(F.md5(docs[text_col].cast("binary")), F.lit(""))
    met = docs[id_col].eqNullSafe(keys["_key_id"]) & (own_hash == keys["_key_hash"])
    return docs.join(F.broadcast(keys) if fits(keys, 80) else keys, met, how)


def held_out(id_col: str = "doc_id"):
    """True for the rows that no model learns from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def sample_ids(rows: DataFrame, most: int) -> DataFrame:
    """From (id, class): about ``most`` ids of each class, all where there are fewer, chosen by a hash of the id.

    The classes are counted first, then each row decides by itself: nothing is sorted and no class meets in one task.
    """
    share = cut(rows.groupBy("class").agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count(F.lit(1))).alias("share")))
    share = F.broadcast(share) if fits(share, 1000) else share
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("sample")), F.lit(1 << 40)) / float(1 << 40)
    return rows.join(share, "class").filter(place < F.col("share")).select("id", "class")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")

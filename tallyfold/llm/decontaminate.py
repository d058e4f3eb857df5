"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is a set of windows of consecutive words, each window a set of shingles (runs of up to three
words). Shingles are ordered by rarity in the corpus. A document that holds a window holds all its shingles, so that
joining on the window's rarest one, its prefix, loses nothing; the shingle's place in the window gives where the
window must start, which has to lie within the document, and the words there are then compared.

What documents send is found with a bitmap of shingle hashes of fixed size, so that neither the benchmark nor the
corpus has to fit anywhere: only places that may hold a prefix are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm import wordhash
from tallyfold.llm.base import WORD_BYTES, cut, fits, map_texts, row_key, same_key

WINDOW, SHINGLE = 10, 3
#: Bits of the bitmap that every task gets: 2 MB.
BITMAP_BITS = 24
#: Bytes of a row of the windows' prefixes, when such rows are sent to all executors.
INDEX_BYTES = 1000

_PLACE = pa.struct([("h", pa.int64()), ("left", pa.int32()), ("pos", pa.int32()), ("ctx", pa.list_(pa.string()))])


def _raw(text: str | None) -> bytes:
    return text.encode("utf-8", "replace").translate(WORD_BYTES) if text else b""


def windows_of(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """(item, words, shingles) of every window; shingles: the hashes of its runs of SHINGLE words, or of all its words if fewer."""

    def make() -> Callable[[list], dict]:
        def work(texts: list) -> dict:
            kind = pa.list_(pa.struct([("words", pa.list_(pa.string())), ("shingles", pa.list_(pa.int64()))]))
            found = []
            for raw in map(_raw, texts):
                words = [w.decode("utf-8", "replace") for w in raw.split()]
                k = min(SHINGLE, len(words))
                owner, _, _, hashes = wordhash.of_texts([raw])
                runs = wordhash.runs(owner, hashes, k)[1].view(np.int64).tolist() if k else []
                n = min(window, len(words))
                found.append([{"words": words[i : i + n], "shingles": runs[i : i + n - k + 1]} for i in range(len(words) - n + 1)] if n else [])
            return {"windows": pa.array(found, kind)}

        return work

    rows = map_texts(items.select(F.col(id_col).alias("item"), F.col(text_col).alias("text")), make, "windows array<struct<words:array<string>,shingles:array<bigint>>>", "item", "text")
    return rows.select("item", F.inline("windows")).select("item", "words", "shingles", F.concat_ws(" ", "words").alias("window"))


def bitmap(hashes: DataFrame) -> np.ndarray:
    """A bit for the leading BITMAP_BITS bits of each value of column h; at most 2^(BITMAP_BITS - 6) rows reach the driver."""
    bit = F.shiftrightunsigned(F.col("h"), 64 - BITMAP_BITS)
    words = hashes.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BITMAP_BITS}) & 63 as int))").alias("b"))
    rows = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    out[rows["w"].to_numpy(dtype=np.int64)] = rows["b"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - BITMAP_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def shingle_counts(docs: DataFrame, bits: np.ndarray, sizes: list[int], text_col: str) -> DataFrame:
    """(h, n): occurrences in all texts of the shingles that the bitmap lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make() -> Callable[[list], dict]:
        def work(texts: list) -> dict:
            owner, _, _, hashes = wordhash.of_texts([_raw(t) for t in texts])
            runs = [wordhash.runs(owner, hashes, k)[1] for k in sizes]
            h, n = np.unique(np.concatenate([x[_in(shared.value, x)] for x in runs]), return_counts=True)
            rows = [[] for _ in texts]
            rows[0] = [{"h": a, "n": b} for a, b in zip(h.view(np.int64).tolist(), n.tolist(), strict=True)]  # of the whole batch
            return {"counts": pa.array(rows, pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())])))}

        return work

    rows = map_texts(docs.select(F.lit(0).alias("id"), F.col(text_col).alias("text")), make, "counts array<struct<h:bigint,n:bigint>>", "id", "text")
    return rows.select(F.inline("counts")).groupBy("h").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, bits: np.ndarray, sizes: list[int], window: int, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, n_words, places): where a text may hold a prefix, each with the words around it."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def make() -> Callable[[list], dict]:
        def work(texts: list) -> dict:
            raws = [_raw(t) for t in texts]
            owner, starts, ends, hashes = wordhash.of_texts(raws)
            first = np.searchsorted(owner, np.arange(len(texts) + 1))
            found: list[list] = [[] for _ in texts]
            for k in sizes:
                at, h = wordhash.runs(owner, hashes, k)
                hit = np.flatnonzero(_in(shared.value, h))
                for p, x in zip(at[hit].tolist(), h[hit].view(np.int64).tolist(), strict=True):
                    d = int(owner[p])
                    lo, hi = max(first[d], p - window + 1), min(first[d + 1], p + window)
                    ctx = [raws[d][starts[i] : ends[i]].decode("utf-8", "replace") for i in range(lo, hi)]
                    found[d].append({"h": x, "left": int(p - lo), "pos": int(p - first[d]), "ctx": ctx})
            return {"n_words": pa.array(np.diff(first), pa.int64()), "places": pa.array(found, pa.list_(_PLACE))}

        return work

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col)[1].alias("text_hash"))
    return map_texts(rows, make, "n_words bigint, places array<struct<h:bigint,left:int,pos:int,ctx:array<string>>>", "id", "text", keep=["text_hash"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The id column, n_words, n_hit (words inside any occurrence of a window), items (sorted array of string ids), contaminated.

    An item of fewer words than the window is one window of its own; an item without words is none. Null and empty
    texts have no words. One row per row. Other columns are not looked at.
    """
    found = of_texts(docs, items, window, id_col, text_col, item_id_col, item_text_col)
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "contaminated")


def of_texts(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """As contamination, with id for the id column, and the text's hash of row_key as text_hash."""
    found = cut(windows_of(items, window, item_id_col, item_text_col).filter(F.size("words") > 0))
    each = found.select("window", "words", "shingles").distinct()
    shingles = each.select("window", F.size("words").alias("n"), F.posexplode("shingles").alias("offset", "h"))
    sizes = [r["k"] for r in each.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("k")).distinct().collect()]  # at most SHINGLE values
    sizes = sorted(sizes) or [SHINGLE]
    rarity = shingle_counts(docs, bitmap(shingles.select("h")), sizes, text_col)
    order = F.struct(F.coalesce("count", F.lit(0)), F.col("h"), F.col("offset"))
    ranked = shingles.join(rarity.withColumnRenamed("n", "count"), "h", "left")
    prefix = cut(ranked.groupBy("window", "n").agg(F.min_by(F.struct("h", "offset"), order).alias("p")).select("window", "n", "p.h", "p.offset"))
    words = each.select("window", "words")
    index = cut(prefix.join(words, "window").join(found.select("window", F.col("item").cast("string").alias("item")).distinct(), "window").drop("window"))

    at = cut(places(docs, bitmap(prefix.select("h")), sizes, window, id_col, text_col))
    # Documents without a place take no part in the join; of rows that repeat id and text, one does.
    some = at.filter(F.size("places") > 0).dropDuplicates(["id", "text_hash"])
    rows = some.select("id", "text_hash", "n_words", F.explode("places").alias("place")).select("id", "text_hash", "n_words", "place.*")
    start = F.col("pos") - F.col("offset")
    inside = (start >= 0) & (start + F.col("n") <= F.col("n_words")) & (F.col("left") >= F.col("offset"))
    same = F.when(inside, F.slice("ctx", F.greatest(F.col("left") - F.col("offset"), F.lit(0)) + 1, F.col("n")) == F.col("words"))
    hit = rows.join(F.broadcast(index) if fits(index, INDEX_BYTES) else index, "h").filter(same)
    hit = hit.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), F.struct(start.alias("s"), (start + F.col("n")).alias("e")).alias("span"), "item")
    grouped = hit.groupBy("_id", "_hash").agg(F.sort_array(F.collect_set("span")).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("e"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a.e, x.e).alias("e"), (a.n + F.greatest(x.e - F.greatest(x.s, a.e), F.lit(0))).alias("n")),
    ).n
    hits = cut(grouped.select("_id", "_hash", covered.alias("n_hit"), "items"))
    out = at.select("id", "text_hash", "n_words").join(F.broadcast(hits) if fits(hits, INDEX_BYTES) else hits, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    out = out.select("id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose text holds no benchmark window. Ids may be null or repeat: other texts of an id stay."""
    found = of_texts(docs, items, id_col=id_col, text_col=text_col).filter("contaminated").select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"))
    return same_key(docs, cut(found.distinct()), id_col, text_col, "left_anti")

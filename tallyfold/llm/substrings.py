"""Substring deduplication by content-defined chunking.

A gear hash rolls over a text's bytes; a chunk ends where the hash is smallest within WINDOW bytes on either side.
Such a place depends on the bytes near it alone, so that a passage is cut alike wherever it stands, and an insertion
moves no border but its own. Where the same few bytes go on and on, no hash is smaller than the others of its kind: such
stretches are cut at equal smallest hashes, that is after whole repetitions, and so alike in all documents too. Chunks
are found again by a 64-bit digest; runs of adjoining chunks that other documents hold too are the repeated passages.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfold.llm.base import cut, let, map_texts, piece, text_blocks

#: Bytes on either side of a border in which its hash is the smallest: chunks have WINDOW + 1 bytes at least, and twice as many on average.
WINDOW = 16
#: A stretch without a border that is longer than this is cut at equal smallest hashes, each so many bytes at least after the one before.
STRETCH, REPEAT = 64, 32
#: A chunk that has none of those either is ended after so many bytes.
LONGEST = 1024
#: A passage counts from so many words on, or so many bytes, for scripts without spaces. The ends that lie outside whole
#: chunks, up to some 90 bytes, are not among them: 34 stands for more than 50.
MIN_WORDS, MIN_BYTES = 34, 360
#: Stands for a null id.
NO_ID = (1 << 63) - 1
#: Bytes that numpy works on at once.
BLOCK_BYTES = 1 << 20
#: Bytes that a border's place depends on, on either side.
_MARGIN = 64

#: The bytes that separate words.
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", dtype=np.uint8))

#: One random 32-bit number for each byte, from a fixed seed.
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)


def _smallest(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose rolling hash is smallest within WINDOW on either side, of equals the first; and those of the other equals."""
    h = GEAR[b]
    for k in (1, 2, 4, 8):  # h[i] = gear[i] + 4 * gear[i - 1] + 16 * gear[i - 2] + ... over 16 bytes
        new = h.copy()
        new[k:] += h[:-k] << np.uint32(2 * k) if len(h) > k else 0
        h = new
    most = np.uint32(0xFFFFFFFF)
    low = np.concatenate([np.full(WINDOW, most), h, np.full(WINDOW + 1, most)])
    k = 1
    while k < WINDOW:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    before, after = low[: len(h)], low[WINDOW + 1 : WINDOW + 1 + len(h)]
    least = (h <= before) & (h <= after)
    first = least & (h < before)
    return np.flatnonzero(first), np.flatnonzero(least & ~first)


def _repeats(lo: int, hi: int, ties: np.ndarray) -> list[int]:
    """Cuts between lo and hi: the ties that are REPEAT bytes at least from the cut before."""
    own = ties[np.searchsorted(ties, lo) : np.searchsorted(ties, hi)]
    out, at = [], int(np.searchsorted(own, lo + REPEAT))
    while at < len(own):
        out.append(int(own[at]))
        at += int(np.searchsorted(own[at : at + REPEAT + 1], out[-1] + REPEAT))
    return out


def borders(raw: bytes) -> np.ndarray:
    """Where chunks begin and end: 0, inner borders at the starts of UTF-8 characters, and the length."""
    n = len(raw)
    b = np.frombuffer(raw, dtype=np.uint8)
    found: tuple[list, list] = [], []
    for s in range(0, n, BLOCK_BYTES):
        lo, hi = max(0, s - _MARGIN), min(n, s + BLOCK_BYTES + _MARGIN)
        for at, out in zip(_smallest(b[lo:hi]), found, strict=True):
            at = at + lo
            out.append(at[(at >= s) & (at < s + BLOCK_BYTES)] + 1)
    cuts = np.concatenate([[0], *found[0], [n]]).astype(np.int64)
    ties = np.concatenate([[0], *found[1]]).astype(np.int64)[1:]
    long = np.flatnonzero(np.diff(cuts) > STRETCH)
    if len(long) and len(ties):
        cuts = np.sort(np.concatenate([cuts, *(np.array(_repeats(int(cuts[i]), int(cuts[i + 1]), ties), dtype=np.int64) for i in long)]))
    wide = np.flatnonzero(np.diff(cuts) > LONGEST)
    if len(wide):
        cuts = np.sort(np.concatenate([cuts, *(np.arange(cuts[i] + LONGEST, cuts[i + 1], LONGEST) for i in wide)]))
    for _ in range(3):  # continuation bytes belong to the character before
        inner = cuts < n
        cuts[inner] += (b[cuts[inner]] & 0xC0) == 0x80
    return np.unique(cuts)


def _key(id_col: str, text_col: str) -> list:
    """(id, text_hash): what tells rows apart. Ids are integers; null is the largest, and stays apart from all others by the text."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("text_hash")]


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, digest, start, end, n_words, n_bytes): a row for each chunk; positions count code points.

    n_words are those that begin in the chunk, at white space. Null and empty texts have no chunks.
    """

    def make() -> Callable[[list], dict]:
        digest = xxhash.xxh3_64_intdigest

        def work(texts: list) -> dict:
            sizes, digests, starts, ends, n_words, n_bytes = [0], [], [], [], [], []
            for t in texts:
                raw = t.encode("utf-8", "replace") if t else b""
                if raw:
                    at = borders(raw)
                    view = memoryview(raw)
                    cuts = at.tolist()
                    digests.append(np.array([digest(view[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)], dtype=np.uint64))
                    space = _SPACE[np.frombuffer(raw, dtype=np.uint8)]
                    begun = np.concatenate([[0], np.cumsum(~space & np.concatenate([[True], space[:-1]]), dtype=np.int32)])
                    n_words.append(np.diff(begun[at]))
                    n_bytes.append(np.diff(at))
                    if not raw.isascii():
                        points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
                        at = points[at]
                    starts.append(at[:-1])
                    ends.append(at[1:])
                sizes.append(len(digests[-1]) if raw else 0)
            flat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
            rows = pa.StructArray.from_arrays(
                [pa.array(flat(digests, np.uint64).view(np.int64)), *[pa.array(flat(x, np.int32)) for x in (starts, ends, n_words, n_bytes)]],
                names=["digest", "start", "end", "n_words", "n_bytes"],
            )
            return {"chunks": pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), rows)}

        return work

    rows = docs.select(*_key(id_col, text_col), F.col(text_col).alias("text"))
    return map_texts(rows, make, "chunks array<struct<digest:bigint,start:int,end:int,n_words:int,n_bytes:int>>", "id", "text", ["text_hash"]).select("id", "text_hash", F.inline("chunks"))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_bytes: int = MIN_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each passage of a document that other documents hold too.

    Columns: the id, text_hash, start and end (code points, end exclusive), n_chunks, run_words, run_bytes, first_id (the
    smallest id that holds the passage's first chunk; null last) and is_first (whether this document's id is that for
    all its chunks). A run is as many adjoining chunks that occur in more than one document as there are; it counts
    from min_words or min_bytes on, and gives one passage, or several where chunks that stand here first adjoin others. Repeats within one
    document alone don't count. Rows are documents of their own where their texts differ, also under one id or without
    one; rows that repeat both are one document.

    Digests are counted before they are shuffled, and the join that brings the counts back leaves digests that very
    many documents share to Spark's splitting of skewed partitions. Texts are cut twice, as that costs less than
    keeping all chunks.
    """
    own = chunks(docs, id_col, text_col)
    ends = [f("id").alias(f"{n}_id") for n, f in (("first", F.min), ("last", F.max))] + [f("text_hash").alias(f"{n}_hash") for n, f in (("first", F.min), ("last", F.max))]
    shared = cut(own.groupBy("digest").agg(*ends).filter("first_id != last_id or first_hash != last_hash").select("digest", "first_id"))
    hits = own.hint("merge").join(shared, "digest").select("id", "text_hash", "start", "end", "n_words", "n_bytes", "first_id")
    key = ["id", "text_hash"]
    hits = hits.repartition(*key).dropDuplicates([*key, "start"])  # rows that repeat id and text
    w = Window.partitionBy(*key).orderBy("start")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.select("*", F.coalesce((F.col("start") > reach).cast("int"), F.lit(0)).alias("new")).select("*", F.sum("new").over(w).alias("run"))
    own_first = F.col("first_id") == F.col("id")
    in_run = Window.partitionBy(*key, "run").orderBy("start")
    turn = F.coalesce((own_first != F.lag(own_first).over(in_run)).cast("int"), F.lit(0))
    of_run = [F.sum(f"n_{x}").over(Window.partitionBy(*key, "run")).alias(f"run_{x}") for x in ("words", "bytes")]
    long = runs.select("*", *of_run, turn.alias("turn")).filter((F.col("run_words") >= min_words) | (F.col("run_bytes") >= min_bytes))
    parts = long.select("*", F.sum("turn").over(in_run).alias("part"))
    found = parts.groupBy(*key, "run", "part").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).cast("long").alias("n_chunks"), *[F.first(x).alias(x) for x in ("run_words", "run_bytes")], F.min_by("first_id", "start").alias("first_id")
    )
    given = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).cast(docs.schema[id_col].dataType)
    return found.select(given("id").alias(id_col), "text_hash", "start", "end", "n_chunks", "run_words", "run_bytes", given("first_id").alias("first_id"), (F.col("id") == F.col("first_id")).alias("is_first"))


def remove_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with every passage cut out of its own row's text, but where it stands in the first document that holds it."""
    spans = passages.filter(~F.col("is_first")).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col("text_hash").alias("_hash"), F.struct("start", "end").alias("span"))
    spans = spans.groupBy("_id", "_hash").agg(F.sort_array(F.collect_list("span")).alias("_spans"))
    own_id, own_hash = _key(id_col, text_col)
    row = docs.select(F.struct("*").alias("row"), own_id.alias("own_id"), own_hash.alias("own_hash"))
    text = F.col("row").getField(text_col)

    def pieces(blocks):
        before = F.transform("_spans", lambda x, i: piece(blocks, F.coalesce(F.get("_spans", i - 1)["end"], F.lit(0)), x["start"]))
        return F.concat(F.array_join(before, ""), piece(blocks, F.element_at("_spans", -1)["end"], F.char_length(text)))

    joined = row.join(spans, (F.col("own_id") == F.col("_id")) & (F.col("own_hash") == F.col("_hash")), "left")
    left = F.when(F.col("_spans").isNull(), text).otherwise(let(text_blocks(text), pieces))
    return joined.select(*[left.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])

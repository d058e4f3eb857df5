"""Quality classification by supervised subword embeddings.

A text is the average of learned vectors of its words and their character n-grams, all hashed into buckets; a softmax
layer gives the classes. Vectors and layer are trained together by stochastic gradient descent in numpy. As the layer
is linear, scoring needs only the difference of its two outputs for each bucket, so that a text costs a few numpy
passes over its characters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import map_texts, sample_ids

#: Trained on about this many labelled documents of each class, chosen by a hash of the id, with their whole texts.
SAMPLE_DOCS = 1500
BUCKETS, DIM, GRAMS = 1 << 16, 8, (3, 4)
EPOCHS, RATE, SEED = 12, 0.6, 7
#: Characters that one pass of numpy works on, whatever the texts' lengths.
BLOCK_CHARS = 1 << 18

#: The hash of every word that repeats the one before it. Without it, held-out texts of repeated words look good: README.
REPEATED = np.uint64(1)

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_SPACE = 0x20
#: ASCII characters with all white space made a space.
_ASCII = np.array([_SPACE if c in b" \t\n\x0b\x0c\r" else c for c in range(128)], dtype=np.uint32)


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind * 0x1000193)) * _MULTIPLY
    mixed ^= mixed >> np.uint64(29)
    return ((mixed * _MULTIPLY) >> np.uint64(64 - 16)).astype(np.int64)


def features(block: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positions, buckets) of the character n-grams and of the words of a block of code points that begins and ends with a space.

    The space at either end of a word takes part in its n-grams as its border. A word that repeats the one just before
    it counts as one more feature, the same for all words: hashed word pairs, of which only whether both are equal is kept.
    """
    b = block
    space = b == _SPACE
    wide = b.astype(np.uint64) + np.uint64(1)
    found = []
    for n in GRAMS:
        if len(b) < n:
            continue
        h, size = np.zeros(len(b) - n + 1, dtype=np.uint64), len(b) - n + 1
        inner = np.zeros(size, dtype=bool)
        for k in range(n):
            h = h * _BASE + wide[k : k + size]
            if 0 < k < n - 1:
                inner |= space[k : k + size]
        at = np.flatnonzero(~inner & ~(space[:size] & space[n - 1 : n - 1 + size] & (n < 3)))
        found.append((at, _bucket(h[at], n)))
    edges = np.flatnonzero(space[:-1] != space[1:]) + 1
    starts, ends = edges[0::2], edges[1::2]
    if len(starts):
        # h = b0 * B^(n-1) + ... + b(n-1), as in the loop above, from running sums: B is odd and so has an inverse.
        inverses = np.cumprod(np.full(len(b), _INVERSE, dtype=np.uint64))
        sums = np.concatenate([[np.uint64(0)], np.cumsum(wide * inverses)])
        h = (sums[ends] - sums[starts]) * np.cumprod(np.full(len(b), _BASE, dtype=np.uint64))[ends - 1]
        found.append((starts, _bucket(h, 0)))
        same = np.flatnonzero((h[1:] == h[:-1]) & (starts[1:] - ends[:-1] == 1)) + 1
        found.append((starts[same], _bucket(np.full(len(same), REPEATED), 1)))
    return found


def _blocks(text: str) -> list[np.ndarray]:
    """A text's code points in blocks of at most BLOCK_CHARS where its words allow, each between spaces."""
    c = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    c = np.where(c < 128, _ASCII[np.minimum(c, 127)], c)
    border, out, at = np.array([_SPACE], dtype=np.uint32), [], 0
    while at < len(c):
        end = len(c)
        if end - at > BLOCK_CHARS:
            spaces = np.flatnonzero(c[at + 1 : at + BLOCK_CHARS] == _SPACE)
            if not len(spaces):
                spaces = np.flatnonzero(c[at + BLOCK_CHARS :] == _SPACE)[:1] + BLOCK_CHARS - 1
            end = at + 1 + int(spaces[-1]) if len(spaces) else end
        out.append(np.concatenate([border, c[at:end], border]))
        at = end + 1 if end < len(c) else end
    return out


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their counts."""
    found = [x for block in _blocks(text or "") for _, x in features(block)]
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    scores: np.ndarray  # for each bucket, what it adds to the logit of label 1
    bias: float

    def logits(self, texts: list) -> np.ndarray:
        """Logits of label 1; texts are joined to blocks, so that numpy's passes are long."""
        total, number = np.zeros(len(texts)), np.zeros(len(texts))
        pending: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal pending, size
            if pending:
                owners, parts = [i for i, _ in pending], [x for _, x in pending]
                border = np.cumsum([len(x) for x in parts])
                for at, bucket in features(np.concatenate(parts)):
                    which = np.searchsorted(border, at, side="right")
                    np.add.at(total, owners, np.bincount(which, self.scores[bucket], len(parts)))
                    np.add.at(number, owners, np.bincount(which, minlength=len(parts)))
            pending, size = [], 0

        for i, text in enumerate(texts):
            for block in _blocks(text or ""):
                pending.append((i, block))
                size += len(block)
                if size >= BLOCK_CHARS:
                    flush()
        flush()
        return self.bias + total / np.maximum(number, 1)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """Stochastic gradient descent over (buckets, counts, label); classes weigh the same. Without rows of both classes, the share of label 1."""
    rng = np.random.default_rng(SEED)
    labels = np.array([y for _, _, y in rows])
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), float(np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))))
    vectors = (rng.random((BUCKETS, DIM)) - 0.5) / DIM
    layer, bias = rng.normal(0, 0.5, (2, DIM)), np.zeros(2)
    weight = len(labels) / (2 * np.bincount(labels, minlength=2))
    docs = [(at, n / max(n.sum(), 1)) for at, n, _ in rows]
    step, steps = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            (at, share), y = docs[k], labels[k]
            mean = share @ vectors[at] if len(at) else np.zeros(DIM)
            z = layer @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            rate = RATE * (1 - step / steps) * weight[y]
            back = layer.T @ p
            layer -= rate * np.outer(p, mean)
            bias -= rate * p
            # A bucket's share of one text is tiny: its vector moves by the gradient without the share's length factor.
            vectors[at] -= rate * np.outer(share / max(np.sqrt((share**2).sum()), 1e-12), back)
            step += 1
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from documents with a label 0 or 1. Features are counted in Spark's tasks; the driver gets a bounded number of rows."""
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("class"))
    ids = docs.select(F.col(id_col).alias("id")).join(known, "id").select("id", "class")
    chosen = sample_ids(ids, SAMPLE_DOCS).groupBy("id").agg(F.max("class").alias("y"))
    # About 2 * SAMPLE_DOCS ids: small enough to send to every executor.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")

    def make() -> Callable[[list], dict]:
        def work(texts: list) -> dict:
            got = [counted(t) for t in texts]
            return {"at": pa.array([x.astype("<i4").tobytes() for x, _ in got], pa.binary()), "n": pa.array([x.astype("<i4").tobytes() for _, x in got], pa.binary())}

        return work

    rows = map_texts(sample, make, "at binary, n binary", "id", "text", keep=["y"]).collect()
    rows.sort(key=lambda r: (r["id"], bytes(r["at"])))
    return train([(np.frombuffer(r["at"], "<i4").astype(np.int64), np.frombuffer(r["n"], "<i4").astype(np.int64), r["y"]) for r in rows])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and score, the probability of label 1; null and empty texts get the model's bias. One row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], dict]:
        return lambda texts: {"score": pa.array(1 / (1 + np.exp(-shared.value.logits(texts))), pa.float64())}

    return map_texts(docs, make, "score double", id_col, text_col)

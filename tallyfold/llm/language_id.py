"""Language identification by words first, with back-off to character n-grams.

A word that the model knows is scored by its log frequency in each language. Any other word falls back to the longest
length of character n-gram of which the model knows at least one, down to single characters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import cut, map_texts, sample_ids

#: The model is fitted on about this many documents of a language, chosen by a hash of the id, with their whole texts.
SAMPLE_DOCS = 1000
#: More languages than this are refused before anything is collected: the model has a number for each word and language.
MAX_LANGUAGES = 200
LONGEST_GRAM = 4
#: Words that a worker remembers beyond those of the model.
MEMO_WORDS = 300_000

_RUNS, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")


def letters(text: str) -> list[str]:
    """Runs of letters (\\p{L}), lower-cased, as fit takes them. Other numbers than digits, such as \u00bd, are no letters."""
    found = _RUNS.findall(text.lower())
    return found if all(map(str.isalpha, found)) else [x for run in found for x in _LETTERS.findall(run)]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, np.ndarray]  # log frequency by language
    grams: dict[str, np.ndarray]


def _log_frequencies(counts: list, languages: list[str]) -> dict[str, np.ndarray]:
    """From (language, key, count, total of the language) to log frequencies; a language that lacks a key counts half an occurrence."""
    at = {x: i for i, x in enumerate(languages)}
    totals = np.ones(len(languages))
    for lang, _, _, total in counts:
        totals[at[lang]] = total
    floor = np.log(0.5 / totals)
    found: dict[str, np.ndarray] = {}
    for lang, key, n, total in counts:
        if key not in found:
            found[key] = floor.copy()
        found[key][at[lang]] = math.log(n / total)
    return found


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a text and a language. Ids and languages alone are read to choose the sample."""
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    if docs.select(lang_col).distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chosen = sample_ids(rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("class")), SAMPLE_DOCS).select("id").distinct()
    # About SAMPLE_DOCS * MAX_LANGUAGES ids of a few bytes at most: small enough to send to every executor.
    sample = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id", "left_semi")
    words = F.filter(F.split(F.lower("text"), r"\P{L}+"), lambda x: x != "")
    counts = cut(sample.select("lang", F.explode(words).alias("key")).groupBy("lang", "key").agg(F.count(F.lit(1)).alias("n")))
    marked = F.concat(F.lit("^"), F.col("key"), F.lit("$"))
    sizes = F.array(*[F.lit(n) for n in range(1, LONGEST_GRAM + 1)])
    grams = F.flatten(
        F.transform(sizes, lambda n: F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.length(marked) - n + 1), lambda i: F.substring(marked, i, n))).otherwise(F.array().cast("array<string>")))
    )
    gram_counts = cut(counts.select("lang", "n", F.explode(grams).alias("key")).groupBy("lang", "key").agg(F.sum("n").alias("n")))

    def counted(d: DataFrame, *by: str) -> list:
        """Rows of language, key, count and total: as many as the sampled texts have different keys."""
        length = F.length("key").alias("length")
        total = d.groupBy("lang", *([length] if by else [])).agg(F.sum("n").alias("total"))
        joined = d.select("*", length).join(F.broadcast(total), ["lang", *by])  # a row for each language and length
        return [(r["lang"], r["key"], r["n"], r["total"]) for r in joined.select("lang", "key", "n", "total").collect()]

    # Frequencies of n-grams are among those of the same length.
    word_counts, gram_rows = counted(counts), counted(gram_counts, "length")
    languages = sorted({x[0] for x in word_counts} | {x[0] for x in gram_rows})
    grams_by_length: dict[str, np.ndarray] = {}
    for n in range(1, LONGEST_GRAM + 1):
        grams_by_length |= _log_frequencies([x for x in gram_rows if len(x[1]) == n], languages)
    return Model(languages, _log_frequencies(word_counts, languages), grams_by_length)


class Scorer(dict):
    """Word -> row of self.table, worked out when first asked for; memory is bounded."""

    def __init__(self, model: Model):
        self.model, n = model, len(model.languages)
        self.table = np.zeros((len(model.words) + MEMO_WORDS + 1, max(n, 1)), dtype="float32")
        self.known = list(model.words)
        self.table[: len(self.known)] = np.array([model.words[w] for w in self.known]).reshape(-1, max(n, 1)) if self.known else 0
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.update((w, i) for i, w in enumerate(self.known))

    def backed_off(self, word: str) -> np.ndarray | float:
        marked = f"^{word}$"
        for n in range(min(LONGEST_GRAM, len(marked)), 0, -1):
            rows = [self.model.grams[g] for i in range(len(marked) - n + 1) if (g := marked[i : i + n]) in self.model.grams]
            if rows:
                return np.mean(rows, axis=0)
        return 0.0

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at < len(self.table):
            self[word] = at
            self.table[at] = self.backed_off(word)
            return at
        return -1

    def score(self, text: str | None) -> tuple[str, float]:
        found = letters(text) if text else []
        if not found or not self.model.languages:
            return "und", 0.0
        if len(self) >= len(self.table) - len(found):
            self.reset()
        at = np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))
        total = self.table[at[at >= 0]].sum(axis=0, dtype=np.float64)
        for w in (found[i] for i in np.flatnonzero(at < 0)):  # a text of more new words than are remembered
            total = total + self.backed_off(w)
        best = int(total.argmax())
        return self.model.languages[best], float(1 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, lang_pred and score: the share of the best language's likelihood; ``und`` and 0 for a text without letters.

    Every row gives one row. The model's size is bounded by its parameters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], dict]:
        scorer = Scorer(shared.value)

        def work(texts: list) -> dict:
            got = [scorer.score(t) for t in texts]
            return {"lang_pred": pa.array([x for x, _ in got], pa.string()), "score": pa.array([y for _, y in got], pa.float64())}

        return work

    return map_texts(docs, make, "lang_pred string, score double", id_col, text_col)

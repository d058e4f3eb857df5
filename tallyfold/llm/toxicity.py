"""Toxicity by a learned lexicon, matched with misspellings and weighed by context.

Terms that mark toxic training documents form a trie; it is walked together with the Levenshtein automata of all its
terms, and that product is made deterministic as far as words need it. Ordinary words that happen to be near a term are
learned as innocent. A match counts by its edits, by whether it stands in quotation marks, and by learned log odds of
the words in a window around it. A logistic regression over these counts, fitted in numpy, gives the score; as few
corpora hold misspelt and quoted terms enough to learn from, it also sees the toxic documents misspelt, and quoted.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import cut, let, map_texts, sample_ids

#: Learned from about this many labelled documents of each class, chosen by a hash of the id, with their whole texts.
SAMPLE_DOCS = 3000
#: A term needs this many different surroundings in toxic documents (copies of one text add none) and one in this share
#: of them, must be this many times as frequent there as in others, and have so many letters.
MIN_CONTEXTS, MIN_SHARE, MIN_RATIO, MIN_LETTERS = 4, 1 / 200, 20.0, 3
#: Edits allowed for a term of at least so many characters.
EDITS = ((8, 2), (5, 1), (0, 0))
CONTEXT_WORDS = 6
#: A word counts as context from so many windows on; its rate in each class is that of both until there are about so many.
MIN_WINDOWS, WINDOWS = 5, 2000.0
MEMO_WORDS, MEMO_STATES = 400_000, 50_000

QUOTES = re.compile("[\"“”„«»‘’]|(?<!\\w)'|'(?!\\w)")
WORD = re.compile(r"[^\W_]+")

FEATURES = ("exact", "one_edit", "two_edits", "quoted", "context", "weight", "share")


def allowed_edits(term: str) -> int:
    return next(k for n, k in EDITS if len(term) >= n)


class FuzzyLexicon:
    """A trie of terms, walked with all words within the allowed edits at once."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.edits: list[int] = [0]  # the most edits allowed to a term below
        for i, term in enumerate(terms):
            at, k = 0, allowed_edits(term)
            self.edits[0] = max(self.edits[0], k)
            for c in term:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.edits.append(0)
                at = self.children[at][c]
                self.edits[at] = max(self.edits[at], k)
            self.ends[at] = i
        self.alphabet = frozenset("".join(terms))
        self.restart()

    def restart(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.members: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.start = self.state({0: 0})

    def state(self, members: dict[int, int]) -> int:
        """The number of a state, -1 for the empty one; members: trie node -> fewest edits so far."""
        todo = list(members)
        while todo:  # a term's character that the word leaves out
            node = todo.pop()
            for child in self.children[node].values():
                e = members[node] + 1
                if e <= self.edits[child] and e < members.get(child, 99):
                    members[child] = e
                    todo.append(child)
        if not members:
            return -1
        key = frozenset(members.items())
        if key not in self.states:
            self.states[key] = len(self.members)
            self.members.append(members)
            self.steps.append({})
        return self.states[key]

    def step(self, at: int, c: str) -> int:
        new: dict[int, int] = {}
        for node, e in self.members[at].items():
            if e + 1 <= self.edits[node]:
                new[node] = min(e + 1, new.get(node, 99))
            for label, child in self.children[node].items():
                cost = e + (label != c)
                if cost <= self.edits[child]:
                    new[child] = min(cost, new.get(child, 99))
        return self.state(new)

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, term) of the nearest term, the first of equals; None if no term is near enough."""
        if len(self.members) > MEMO_STATES:
            self.restart()
        at, alphabet = self.start, self.alphabet
        for c in word:
            c = c if c in alphabet else ""
            steps = self.steps[at]
            to = steps.get(c)
            if to is None:
                to = steps[c] = self.step(at, c)
            if to < 0:
                return None
            at = to
        found = [(e, self.ends[n]) for n, e in self.members[at].items() if self.ends[n] >= 0 and e <= allowed_edits(self.terms[self.ends[n]])]
        return min(found, default=None)


@dataclass
class Lexicon:
    """terms with the log of how much more frequent they are in toxic documents; innocent: words of other documents that are near a term.

    trust: for each term, the chance that a word near it is the term misspelt, and not one more ordinary word.
    """

    terms: list[str]
    log_ratios: list[float]
    trust: list[float]
    innocent: frozenset[str] = frozenset()


@dataclass
class Model:
    lexicon: Lexicon
    context: dict[str, float]  # word -> log odds of abuse where it stands in the window of a match
    weights: np.ndarray  # of FEATURES, then the bias


class Matcher(dict):
    """Word -> its match; memory is bounded. A word that is innocent matches nothing but itself."""

    def __init__(self, lexicon: Lexicon):
        self.fuzzy, self.innocent = FuzzyLexicon(lexicon.terms), lexicon.innocent

    def __missing__(self, word: str):
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = self.fuzzy.match(word)
        found = self[word] = None if found and found[0] and word in self.innocent else found
        return found


@dataclass
class Hit:
    """A match: positions count code points of the lower-cased text; window: the words around it."""

    start: int
    end: int
    term: int
    edits: int
    quoted: bool
    window: list[str]


def spans(text: str, matcher: Matcher) -> list[Hit]:
    """The matches of a text, in order. Quoted is one that stands between an odd quotation mark before it and another after it, within its window and line."""
    lower = text.lower()
    found = WORD.findall(lower)
    hits = [(i, m) for i, m in enumerate(map(matcher.__getitem__, found)) if m]
    if not hits:
        return []
    places = [m.span() for m in WORD.finditer(lower)]
    out = []
    for i, (edits, term) in hits:
        lo, hi = max(0, i - CONTEXT_WORDS), min(len(found) - 1, i + CONTEXT_WORDS)
        start, end = places[i]
        before, after = lower[places[lo - 1][1] if lo else 0 : start].rpartition("\n")[2], lower[end : places[hi + 1][0] if hi + 1 < len(places) else len(lower)].partition("\n")[0]
        quoted = len(QUOTES.findall(before)) % 2 == 1 and bool(QUOTES.search(after))
        out.append(Hit(start, end, term, edits, quoted, [*found[lo:i], *found[i + 1 : hi + 1]]))
    return out


def features(found: list[Hit], n_chars: int, lexicon: Lexicon, context: dict[str, float]) -> list[float]:
    """FEATURES of a text of so many characters, from its matches."""
    if not found:
        return [0.0] * len(FEATURES)
    plain = [x for x in found if not x.quoted]
    count = lambda hits: float(np.log1p(sum(1.0 if x.edits == 0 else lexicon.trust[x.term] for x in hits)))
    around = [context.get(w, 0.0) for x in plain for w in x.window]
    return [
        count([x for x in plain if x.edits == 0]),
        count([x for x in plain if x.edits == 1]),
        count([x for x in plain if x.edits == 2]),
        count([x for x in found if x.quoted]),
        sum(around) / max(len(around), 1),
        max((lexicon.log_ratios[x.term] * (1.0 if x.edits == 0 else lexicon.trust[x.term]) for x in plain), default=0.0) / 5,
        min(1.0, 100 * len([x for x in plain if x.edits == 0]) / (n_chars / 6 + 1)) / 5,
    ]


def misspelt(word: str, edits: int) -> str:
    """A word with so many letters replaced, dropped or doubled; which ones follows from the word."""
    rnd = random.Random(word)
    for k in range(edits):
        i = rnd.randrange(1, len(word)) if len(word) > 1 else 0
        word = (word[:i] + word[i + 1 :], word[:i] + word[i - 1] + word[i:], word[:i] + rnd.choice("xqz") + word[i + 1 :])[(k + len(word)) % 3]
    return word


def rewritten(text: str, found: list[Hit], by: Callable[[str, Hit], str]) -> str:
    """The lower-cased text with every match put otherwise."""
    lower, at, out = text.lower(), 0, []
    for x in found:
        out += [lower[at : x.start], by(lower[x.start : x.end], x)]
        at = x.end
    return "".join([*out, lower[at:]])


def variants(text: str, found: list[Hit], lexicon: Lexicon) -> list[tuple[str, int]]:
    """Copies of a toxic text, with their labels: its matches in quotation marks, 0; and, where its terms are mostly misspelt if anything, its matches misspelt, 1.

    Misspelt are terms of full enough trust by as many edits as they allow; other matches are left out of that copy.
    """
    edits = lambda x: allowed_edits(lexicon.terms[x.term]) if lexicon.trust[x.term] >= 0.5 else 0
    out = [(rewritten(text, found, lambda w, x: f'"{w}"'), 0)]
    if any(map(edits, found)):
        out.append((rewritten(text, found, lambda w, x: misspelt(lexicon.terms[x.term], edits(x)) if edits(x) else ""), 1))
    return out


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """From (id, text, y): words with many surroundings in toxic texts and few in others, and other texts' words that are near them."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    placed = let(words, lambda w: F.transform(w, lambda x, i: F.struct(x.alias("term"), F.xxhash64(F.get(w, i - 1), F.get(w, i + 1)).alias("c"))))
    # Pairs of a word and its surroundings, made before they are rows: no row carries the text's words.
    pairs = sample.select("id", "y", F.explode(placed).alias("p")).select("id", "y", "p.term", "p.c")
    one = pairs.groupBy("term", "c", "y").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    toxic, other = F.col("y") == 1, F.col("y") == 0
    by_term = cut(one.groupBy("term").agg(F.sum(toxic.cast("long")).alias("toxic"), F.sum(other.cast("long")).alias("other"), F.min(F.when(other, F.col("lo"))).alias("lo"), F.max(F.when(other, F.col("hi"))).alias("hi")))
    total = by_term.agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).first()
    least = max(MIN_CONTEXTS, MIN_SHARE * sample.filter("y = 1").count())
    ratio = (F.col("toxic") / float(total["t"] or 1)) / ((F.col("other") + 2) / float((total["o"] or 0) + 1))
    chosen = by_term.filter((F.col("toxic") >= least) & (F.length("term") >= MIN_LETTERS)).select("term", "toxic", ratio.alias("ratio")).filter(F.col("ratio") >= MIN_RATIO)
    rows = sorted((r["term"], float(np.log(r["ratio"]))) for r in chosen.collect())
    terms = [t for t, _ in rows]
    shared = sample.sparkSession.sparkContext.broadcast(terms)

    def make() -> Callable[[list], dict]:
        fuzzy = FuzzyLexicon(shared.value)
        return lambda found: {"near": pa.array([m[1] if m and m[0] else None for m in map(fuzzy.match, found)], pa.int32())}

    # A word of one document alone is taken as unknown: that is how words look that the sample has not seen.
    ordinary = by_term.filter("lo < hi").select("term", F.col("term").alias("word"))
    near = map_texts(ordinary, make, "near int", "term", "word").filter("near is not null").collect() if terms else []
    ordinary_near = Counter(r["near"] for r in near)
    return Lexicon(terms, [x for _, x in rows], [1 / (1 + ordinary_near[i]) for i in range(len(terms))], frozenset(r["term"] for r in near))


def learn_context(sample: DataFrame, lexicon: Lexicon) -> dict[str, float]:
    """Log odds of abuse for words in the windows of matches. Where one side has few windows, the rate of both holds: that tells nothing."""
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)

    def make() -> Callable[[list], dict]:
        matcher = Matcher(shared.value)
        return lambda texts: {"window": pa.array([[w for x in spans(t or "", matcher) for w in x.window] for t in texts], pa.list_(pa.string()))}

    rows = map_texts(sample, make, "window array<string>", "id", "text", ["y"]).select("y", F.explode("window").alias("word"))
    counts = cut(rows.groupBy("word").agg(F.sum("y").cast("double").alias("t"), F.sum(1 - F.col("y")).cast("double").alias("o")))
    total = counts.agg(F.coalesce(F.sum("t"), F.lit(0.0)).alias("t"), F.coalesce(F.sum("o"), F.lit(0.0)).alias("o")).first()
    rate = (F.col("t") + F.col("o")) / max(total["t"] + total["o"], 1)
    smooth = lambda side: (F.col(side) + WINDOWS * rate) / (total[side] + WINDOWS)
    kept = counts.filter(F.col("t") + F.col("o") >= MIN_WINDOWS).select("word", F.log(smooth("t") / smooth("o")).alias("odds"))
    return {r["word"]: r["odds"] for r in kept.collect()}


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Ridge logistic regression by Newton's method; without rows, a bias of one half."""
    x = np.hstack([x.reshape(len(y), len(FEATURES)), np.ones((len(y), 1))])
    weight = np.ones(len(y)) if weight is None else weight
    w, ridge = np.zeros(len(FEATURES) + 1), np.diag([1.0] * len(FEATURES) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn lexicon, context and weights from documents with a label 0 or 1; the driver gets a bounded number of small rows.

    Every toxic document with a match is seen three times: as it is, misspelt (toxic still), and with its matches in
    quotation marks (not toxic). A class that was sampled weighs as much as all of its documents.
    """
    known = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("class"))
    ids = docs.select(F.col(id_col).alias("id")).join(known, "id").select("id", "class")
    chosen = sample_ids(ids, SAMPLE_DOCS).groupBy("id").agg(F.max("class").alias("y"))
    # About 2 * SAMPLE_DOCS ids: small enough to send to every executor.
    sample = cut(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id"))
    lexicon = learn_lexicon(sample)
    context = learn_context(sample, lexicon)
    shared = docs.sparkSession.sparkContext.broadcast((lexicon, context))

    def make() -> Callable[[list], dict]:
        lexicon, context = shared.value
        matcher = Matcher(lexicon)

        def of(text: str, y: int) -> list[list[float]]:
            """Rows of label and features: of the text, and of its copies if it is toxic."""
            found = spans(text, matcher)
            copies = variants(text, found, lexicon) if y and found else []
            return [[float(y), *features(found, len(text), lexicon, context)], *([float(z), *features(spans(t, matcher), len(t), lexicon, context)] for t, z in copies)]

        return lambda packed: {"x": pa.array([of(p["text"], p["y"]) for p in packed], pa.list_(pa.list_(pa.float64())))}

    packed = sample.select("id", "y", F.struct("text", "y").alias("packed"))
    rows = map_texts(packed, make, "x array<array<double>>", "id", "packed", ["y"]).select("x", "y").collect()
    seen = [(x[1:], x[0], r["y"]) for r in rows for x in r["x"]]
    counts = {r["class"]: r["n"] for r in ids.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    sampled = Counter(r["y"] for r in rows)
    weight = np.array([counts.get(c, 1) / max(sampled[c], 1) for _, _, c in seen])
    weight *= len(seen) / weight.sum() if len(seen) else 1.0
    return Model(lexicon, context, train(np.array([x for x, _, _ in seen]), np.array([y for _, y, _ in seen]), weight))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column and score, the probability of label 1; null and empty texts get that of a text without matches. One row per row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list], dict]:
        lexicon, context, w = shared.value.lexicon, shared.value.context, shared.value.weights
        matcher = Matcher(lexicon)

        def work(texts: list) -> dict:
            x = np.array([features(spans(t, matcher), len(t), lexicon, context) for t in (t or "" for t in texts)]).reshape(len(texts), len(FEATURES))
            return {"score": pa.array(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -700, 700))), pa.float64())}

        return work

    return map_texts(docs, make, "score double", id_col, text_col)

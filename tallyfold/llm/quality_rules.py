"""Quality rules as a bitmask ledger.

Every rule is evaluated once for a document; the ledger keeps the measurements and one failure bit per rule. A policy
is a named, versioned mask over those bits, so that policies and ablations need no second look at a text: they are
bitwise operations on the ledger. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import cut, where

#: The six ASCII white-space characters that separate words.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition on the measurements holds."""

    bit: int
    name: str
    fails: str


#: Bits are never given to another rule, so that old ledgers stay readable.
RULES = (
    Rule(0, "too_few_words", "n_words < 50"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule(5, "capitals", "n_letters > 0 and 2 * n_capitals > n_letters"),
    Rule(6, "exclamations", "5 * n_exclamations > n_words"),
)
BASE = ("too_few_words", "repeated_windows")
ALL = sum(1 << r.bit for r in RULES)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_exclamations", "n_letters", "n_capitals")

#: Policy -> the names of the rules that it applies.
POLICIES = {
    "base-1": BASE,
    "web-1": tuple(r.name for r in RULES),
    "web-2": tuple(r.name for r in RULES if r.name not in ("capitals", "exclamations")),
}


def _mask(names) -> int:
    return sum(1 << r.bit for r in RULES if r.name in set(names))


def _count(text: Column, chars: str) -> Column:
    return (F.char_length(text) - F.char_length(F.translate(text, chars, ""))).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column (or struct) and the measurements, one row per row; null is as an empty text: zeros.

    Repeated word triples are found by their 64-bit hashes, sorted within the document: memory and time follow one
    text's length (n log n), and no row leaves its partition. Two different triples of one text share a hash with
    a chance of about n^2 / 4e19.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col), text.alias("_t"))
    d = d.select(
        id_col,
        "_t",
        F.array_remove(F.split("_t", f"[{SPACES}]+"), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("_l"),
    )
    triples = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)),
    )
    d = d.select("*", F.when(F.size("_w") >= 3, triples).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    ranked = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = d.select("*", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), ranked).otherwise(none).alias("_s"))
    twice = F.filter("_s", lambda x, k: F.coalesce(x.h == F.get("_s", k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("_s", k + 1).h, F.lit(False)))
    d = d.select("*", F.sort_array(F.transform(twice, lambda x: x.i)).alias("_p"))
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    letters = F.regexp_replace("_t", r"\P{L}+", "")
    return d.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        _count(F.col("_t"), SYMBOLS).alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        _count(F.col("_t"), "!").alias("n_exclamations"),
        F.char_length(letters).cast("long").alias("n_letters"),
        F.char_length(F.regexp_replace("_t", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and failed: a bit for each rule that the document fails."""
    bits = None
    for r in RULES:
        bit = F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(0).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    # A filter on the result stops here: pushed into the measurements, it would have them worked out for each mention.
    return where(measure(docs, id_col, text_col), F.lit(True)).select("*", bits.alias("failed"))


def apply_policy(ledger: DataFrame, policy: str = "web-1") -> DataFrame:
    """The ledger with policy and kept: whether none of the policy's rules failed."""
    return ledger.select("*", F.lit(policy).alias("policy"), (F.col("failed").bitwiseAND(F.lit(_mask(POLICIES[policy])).cast("long")) == 0).alias("kept"))


def patterns(ledger: DataFrame) -> DataFrame:
    """(failed, n): how many documents have each pattern of failure bits, of which there are at most 2^rules."""
    return ledger.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))


def ablations_of(counts: DataFrame, policy: str) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without) for each rule of a policy, from counts of patterns, by bits alone."""
    mask = _mask(POLICIES[policy])
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in POLICIES[policy]])
    each = counts.select(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("bits"), "n", F.inline(rules))
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return each.groupBy("rule").agg(
        count(has).alias("n_failed"), count(has & (others == 0)).alias("n_only"), count(others == 0).alias("n_kept_without")
    )


def ablations(ledger: DataFrame, policy: str = "web-1") -> DataFrame:
    """For each rule of a policy: n_failed, n_only (documents that this rule alone rejects) and n_kept_without."""
    return ablations_of(patterns(ledger), policy)


def all_ablations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(policy, and the columns of ablations) for every policy, from one ledger of all documents, which is counted once. No documents give no rows."""
    counts = cut(patterns(ledger(docs, id_col, text_col)))
    found = None
    for name in POLICIES:
        one = ablations_of(counts, name).select(F.lit(name).alias("policy"), "*")
        found = one if found is None else found.unionByName(one)
    return found


def verdicts(docs: DataFrame, policy: str = "web-1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements, base_failed, kept, failed and policy for every row."""
    base = F.col("failed").bitwiseAND(F.lit(_mask(BASE)).cast("long")) != 0
    d = apply_policy(ledger(docs, id_col, text_col), policy).withColumn("base_failed", base)
    return d.withColumn("kept", F.col("kept") & ~F.col("base_failed"))


def keep_documents(docs: DataFrame, policy: str = "web-1", text_col: str = "text") -> DataFrame:
    """The rows, all columns, that neither a base rule nor the policy rejects."""
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return where(verdicts(packed, policy, "row", "text"), F.col("kept")).select("row.*")

"""Fill-in-the-middle: a text is cut after two of its units, and its parts are put in another order with markers.

The cut is found by an injected delimiter, with built-in functions only: the delimiter is escaped in the text, a regular
expression puts one after every unit, their number is that of the units, and the parts between ranks are taken by
substring_index, freed of delimiters and unescaped. All of that is linear in the text, and no row leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Put after every unit; what it is escaped with in texts; and what stands behind the latter for itself and for the former.
DELIMITER, ESCAPE, OF_ESCAPE, OF_DELIMITER = "\x01", "\x02", "\x03", "\x04"
#: A run of letters or one other character, which may be an escaped one.
UNIT = f"(?s)[A-Za-z]+|{ESCAPE}.|[^A-Za-z]"
#: What stands before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Of 100 texts so many are turned, and of those so many have the suffix first.
TURNED, SUFFIX_FIRST = 90, 20
SEED = "1"


def _replace(x: Column, a: str, b: str) -> Column:
    return F.replace(x, F.lit(a), F.lit(b))


def _escaped(x: Column) -> Column:
    return _replace(_replace(x, ESCAPE, ESCAPE + OF_ESCAPE), DELIMITER, ESCAPE + OF_DELIMITER)


def _freed(x: Column) -> Column:
    return _replace(_replace(_replace(x, DELIMITER, ""), ESCAPE + OF_DELIMITER, DELIMITER), ESCAPE + OF_ESCAPE, ESCAPE)


def _ranks(marked: Column, count: Column) -> Column:
    """So many units from the left, or, if negative, pieces from the right, of which the last is what follows the last delimiter."""
    return F.call_function("substring_index", marked, F.lit(DELIMITER), count)


def numbers(id_col: str, seed: str = SEED) -> list[Column]:
    """h1 to h4: four unsigned 32-bit numbers from the sha256 of the seed, a colon and the id; a null id is as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, seed: str = SEED, turned: int = TURNED, suffix_first: int = SUFFIX_FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain) and output, one row per row.

    psm: prefix, suffix, middle, each after its marker; spm: suffix, prefix, middle. Plain texts stay as they are: empty
    ones (null is as empty), those that contain a marker, and those whose third number is not among the turned. The cuts
    come from the id alone, so rows that repeat give the same; other columns are not looked at.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), *numbers(id_col, seed))
    d = d.select("*", _escaped(F.col("t")).alias("escaped"))
    d = d.select("id", "t", "h1", "h2", "h3", "h4", "escaped", F.regexp_replace("escaped", UNIT, "$0" + DELIMITER).alias("marked"))
    n = (F.octet_length("marked") - F.octet_length("escaped")).cast("int")  # a delimiter is one byte
    d = d.select("id", "t", "h1", "h2", "h3", "h4", "marked", n.alias("n"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    marker = F.lit(False)
    for m in MARKERS:
        marker = marker | F.contains("t", F.lit(m))
    plain = (F.col("t") == "") | marker | (F.col("h3") % 100 >= turned)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    d = d.select("id", "t", "marked", "n", F.least(a, b).cast("int").alias("a"), F.greatest(a, b).cast("int").alias("b"), form.alias("form"))
    cut = lambda x: F.when(F.col("form") != "plain", _freed(x))
    a, b, marked = F.col("a"), F.col("b"), F.col("marked")
    parts = [_ranks(marked, a), _ranks(_ranks(marked, b), a - b), _ranks(marked, b - F.col("n") - 1)]
    d = d.select("id", "t", "n", "form", *[cut(x).alias(c) for x, c in zip(parts, ("prefix", "middle", "suffix"), strict=True)])
    p, s, m = (F.lit(x) for x in MARKERS)
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("t"))
    chars = [F.char_length(x).cast("long").alias(f"{x}_chars") for x in ("prefix", "middle")]
    return d.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n"), "form", *chars, output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text, from output and form alone. No part holds a marker, nor can one arise where a part meets a marker: each is there once."""
    p, s, m = MARKERS
    after = lambda x, mark: F.substring_index(x, mark, -1)
    until = lambda x, mark: F.substring_index(x, mark, 1)
    middle = after(output, m)
    psm = F.concat(until(after(output, p), s), middle, until(after(output, s), m))
    spm = F.concat(until(after(output, p), m), middle, until(after(output, s), p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

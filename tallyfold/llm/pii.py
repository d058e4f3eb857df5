"""Sanitising of personal data, and of terms that reveal it.

Patterns find the protected entities. From the whole corpus, the terms that stand near an entity are counted with it
and by themselves; a term that makes an entity much more likely tells who or what it is (pointwise mutual information
against the entity's own information content). Protected are each value and the part of it that names a group: an
address's domain, a network, an area code, a card's issuer. Terms beyond a threshold are generalised in the documents
where they stand near the entity, those that all but name it are removed. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyfold.llm.base import cut, fits, let, piece, row_key, running, text_blocks

#: Kind -> pattern and a cheap sign without which it can't match. Possessive, and starting only where a run of its
#: first characters starts: the same matches as without, in time linear in the text.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}

#: Different texts in which a term has to stand near an entity, or near one of its group, before anything is concluded:
#: a word that one text alone has tells nothing, however rare it is.
SUPPORT = 3
#: Words on either side of an entity that count as near it; words with digits or @ are skipped.
NEAR = 8
#: A term's documents are counted with this many more without the entity, which were not seen: a term that stands in
#: one document alone is some evidence, and one that stands in many, always with the entity, is more.
UNSEEN = 1
#: Share of the entity's information content that a term may give away before it is generalised, and removed.
GENERALISE, REMOVE = 0.9, 0.98
#: Bytes of a row of a term with its hash table entry, when such rows are sent to all executors.
TERM_BYTES = 200

_SPAN = "struct<start:int,end:int,value:string,near:array<string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    digit = lambda i: F.substring(digits, n - i + 1, 1).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + digit(i) - F.when(digit(i) > 9, 9).otherwise(0)) % 10 == 0


def _passes(kind: str, x: Column) -> Column:
    n = F.char_length(_digits(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(x))).otherwise(False)
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _words(text: Column) -> Column:
    # Lower-cased word by word: of a whole text, that can move or part words (U+0130 becomes a letter and a mark).
    return F.transform(F.filter(F.split(text, r"\P{L}+"), lambda x: x != ""), F.lower)


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"\S*[0-9@]\S*", " ")


def _placed(parts: Column, gaps: Column) -> Column:
    """(start, end, value, k) of parts, each with a gap before it."""
    sizes = F.transform(parts, lambda x, i: F.char_length(F.get(gaps, i)) + F.char_length(x))
    return let(running(sizes), lambda at: F.transform(parts, lambda x, i: F.struct((F.get(at, i + 1) - F.char_length(x)).alias("start"), F.get(at, i + 1).alias("end"), x.alias("value"), i.alias("k"))))


def _near(spans: Column, gaps: Column, near: int) -> Column:
    """spans with the words on either side of each, from gaps, which lie before, between and after all matches."""
    words = F.transform(gaps, lambda g: _words(_plain(g)))

    def around(w: Column) -> Column:
        flat, before = F.flatten(w), running(F.transform(w, lambda x: F.size(x)))

        def of(x: Column, b: Column, f: Column) -> Column:
            n = F.get(b, x["k"] + 1)
            first = F.greatest(n - near, F.lit(0))
            return F.slice(f, first + 1, n - first + near)

        return let(before, lambda b: let(flat, lambda f: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value"), of(x, b, f).alias("near")))))

    return let(words, around)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """(_id, _hash, email, ip, card, phone): the row's key and for each kind its matches that pass, by start.

    A match is (start, end, value, near), near the words on either side. Positions count code points, end exclusive.
    Null is as an empty text. One row per row. Time is linear in the text, however many matches there are.
    """
    d = docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    parts = []
    for kind, (pattern, sign) in PATTERNS.items():
        # regexp_extract_all returns the matches, and split what lies between them: their lengths give the places.
        may = F.contains(F.col("text"), F.lit(sign)) if sign else F.regexp_like("text", F.lit("[0-9]"))
        may = may & F.regexp_like("text", F.lit(r"[0-9]\.[0-9]")) if kind == "ip" else may
        parts += [
            F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none).alias(f"{kind}_m"),
            F.when(may, F.split("text", pattern, -1)).otherwise(none).alias(f"{kind}_g"),
        ]
    d = d.select("_id", "_hash", *parts)
    return d.select("_id", "_hash", *[_spans(kind, F.col(f"{kind}_m"), F.col(f"{kind}_g"), near).alias(kind) for kind in PATTERNS])


def _spans(kind: str, matches: Column, gaps: Column, near: int) -> Column:
    empty = F.array().cast(f"array<{_SPAN}>")
    passing = F.filter(_placed(matches, gaps), lambda x: _passes(kind, x["value"]))
    return F.when(F.size(matches) > 0, let(passing, lambda at: F.when(F.size(at) > 0, _near(at, gaps, near).cast(f"array<{_SPAN}>")).otherwise(empty))).otherwise(empty)


def _entities(kind: str, value: Column) -> Column:
    """What a match gives away: the value, and the part that names its group."""
    if kind in ("email", "ip"):
        whole = F.lower(value)
        part = F.substring_index(whole, "@", -1) if kind == "email" else F.substring_index(whole, ".", 2)
    else:
        whole = _digits(value)
        part = F.substring(whole, 1, 6 if kind == "card" else 4)
    return F.array(F.concat(F.lit(f"{kind}:"), whole), F.concat(F.lit(f"{kind} group:"), part))


def evidence(found: DataFrame) -> DataFrame:
    """(entity, term, doc): the words near each entity in each document, each once; term is null where there is none."""
    each = lambda k: F.transform(F.col(k), lambda x: F.struct(_entities(k, x["value"]).alias("entities"), x["near"].alias("near")))
    hits = map(each, PATTERNS)
    rows = found.select(F.struct("_id", "_hash").alias("doc"), F.explode(F.concat(*hits)).alias("x"))
    rows = rows.select("doc", F.explode("x.entities").alias("entity"), "x.near")
    return rows.select("entity", F.explode_outer("near").alias("term"), "doc").distinct()


def disclosing_terms(docs: DataFrame, near_rows: DataFrame, total: int, text_col: str = "text", generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, share): terms that give away at least that share of an entity's information.

    An entity in n of all documents has log2(all / n) bits. A term in m documents, k of them with the entity near it,
    leaves log2((m + UNSEEN) / k) of them. The k documents have SUPPORT different texts at least, so that neither a word
    seen once nor copies of one text make a term, whatever else the corpus holds. All documents are counted, with their
    whole texts.
    """
    n_entity = near_rows.select("entity", "doc").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    seen = near_rows.filter(F.col("term").isNotNull()).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.count_distinct("doc._hash").alias("n_texts"))
    both = seen.filter(F.col("n_texts") >= SUPPORT).drop("n_texts")
    own = F.log2(F.lit(float(total)) / F.col("n_entity"))
    # Of a term in as many documents as hold it near the entity: what can't disclose even then is not counted at all.
    at_best = F.log2((F.col("n_both") + UNSEEN) / F.col("n_both"))
    judged = cut(both.join(n_entity, "entity").select("entity", "term", "n_both", own.alias("own"), at_best.alias("at_best")).filter((F.col("own") > 0) & (F.col("own") - F.col("at_best") >= generalise * F.col("own"))))
    terms = judged.select("term").distinct()
    each = docs.select(F.explode(F.array_distinct(_words(F.coalesce(F.col(text_col), F.lit(""))))).alias("term"))
    if fits(terms, TERM_BYTES):
        each = each.join(F.broadcast(terms), "term", "left_semi")
    # Counted before they are shuffled: what is sent is each task's vocabulary, not its text.
    n_term = each.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    left = F.log2((F.greatest(F.col("n_term"), F.col("n_both")) + UNSEEN) / F.col("n_both"))
    scored = judged.join(n_term, "term").select("entity", "term", ((F.col("own") - left) / F.col("own")).alias("share"))
    return scored.filter(F.col("share") >= generalise)


def marked(docs: DataFrame, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _hash, email, ip, card, phone, terms): a row for each key that has an entity; terms: (term, gone) to be marked in it.

    In a document, the terms that stand near one of its entities count, wherever else they stand in it.
    """
    found = cut(find(docs, id_col, text_col, near))
    total = found.count()
    held = found.filter(F.size(F.concat(*[F.col(k) for k in PATTERNS])) > 0).dropDuplicates(["_id", "_hash"])
    near_rows = cut(evidence(found))
    disclosing = cut(disclosing_terms(docs, near_rows, total, text_col))
    few = F.broadcast(disclosing) if fits(disclosing, TERM_BYTES) else disclosing
    best = near_rows.join(few, ["entity", "term"]).groupBy("doc", "term").agg(F.max("share").alias("share"))
    terms = best.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("term", (F.col("share") >= REMOVE).alias("gone")))).alias("terms"))
    terms = terms.select(F.col("doc._id").alias("_t_id"), F.col("doc._hash").alias("_t_hash"), "terms")
    met = F.col("_id").eqNullSafe(F.col("_t_id")) & (F.col("_hash") == F.col("_t_hash"))
    return cut(held.join(terms, met, "left").drop("_t_id", "_t_hash"))


def _term_spans(text: Column, terms: Column) -> Column:
    """Places of the terms in the text; value is removed or generalised. Words and what lies between them alternate."""
    names = lambda rows: F.transform(rows, lambda t: t["term"])
    gone = names(F.filter(terms, lambda t: t["gone"]))

    def walk(words: Column, gaps: Column, all_: Column, out: Column) -> Column:
        hit = F.filter(_placed(words, gaps), lambda x: F.array_contains(all_, F.lower(x["value"])))
        value = lambda x: F.when(F.array_contains(out, F.lower(x["value"])), F.lit("removed")).otherwise(F.lit("generalised"))
        return F.transform(hit, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), value(x).alias("value"), F.array().cast("array<string>").alias("near")))

    words, gaps = F.filter(F.split(text, r"\P{L}+", -1), lambda x: x != ""), F.split(text, r"\p{L}+", -1)
    return let(words, lambda w: let(gaps, lambda g: let(names(terms), lambda n: let(gone, lambda o: walk(w, g, n, o)))))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: Column | None = None) -> DataFrame:
    """(id, text, row, email, ip, card, phone, term) for every row: matches by start, and terms that reveal one of them.

    Null is as an empty text. keep is carried as row. Three passes over the texts: matches, terms' documents, places.
    """
    keys = marked(docs, id_col=id_col, text_col=text_col)
    keys = keys.select(F.col("_id").alias("_k_id"), F.col("_hash").alias("_k_hash"), *PATTERNS, "terms")
    keep = F.lit(None) if keep is None else keep
    d = docs.select(*row_key(id_col, text_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"), keep.alias("row"))
    d = d.join(keys, F.col("_id").eqNullSafe(F.col("_k_id")) & (F.col("_hash") == F.col("_k_hash")), "left")
    empty = F.array().cast(f"array<{_SPAN}>")
    term = F.when(F.size("terms") > 0, _term_spans(F.col("text"), F.col("terms")).cast(f"array<{_SPAN}>")).otherwise(empty)
    return d.select(F.col("_id").alias("id"), "text", "row", *[F.coalesce(F.col(k), empty).alias(k) for k in PATTERNS], term.alias("term"))


def span_list(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, joined by commas."""

    def each(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*map(each, kinds)), ",")


def sanitised(found: DataFrame) -> Column:
    """The text with entities replaced by their kind in brackets, terms by [term], and removed terms cut out.

    Spans that overlap are one, under the name of the first. Time is linear in the text and the number of spans.
    """
    by = lambda k, x: F.when(x["value"] == "removed", F.lit("")).otherwise(F.lit("[term]")) if k == "term" else F.lit(f"[{k}]")
    label = lambda k: lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("neg_end"), by(k, x).alias("by"))
    spans = F.sort_array(F.concat(*[F.transform(F.col(k), label(k)) for k in [*PATTERNS, "term"]]))

    def rewritten(s: Column, reach: Column, blocks: Column) -> Column:
        first = F.filter(F.transform(s, lambda x, i: F.struct(x["start"].alias("start"), F.get(reach, i).alias("from"), x["by"].alias("by"))), lambda x: x["start"] >= x["from"])
        pieces = F.transform(first, lambda x: F.concat(piece(blocks, x["from"], x["start"]), x["by"]))
        rest = piece(blocks, F.element_at(reach, -1), F.char_length("text"))
        return F.concat(F.array_join(pieces, ""), rest)

    ends = lambda s: running(F.transform(s, lambda x: -x["neg_end"]), F.greatest)
    new = let(spans, lambda s: let(ends(s), lambda reach: let(text_blocks(F.col("text")), lambda blocks: rewritten(s, reach, blocks))))
    return F.when(F.size(F.concat(*[F.col(k) for k in [*PATTERNS, "term"]])) > 0, new).otherwise(F.col("text"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs, all columns, with sanitised texts and, where there is such a column, their lengths. Null texts stay null."""
    found = personal_data(docs, id_col, text_col, F.struct(*docs.columns))
    new = F.when(F.col("row")[text_col].isNotNull(), sanitised(found))
    found = found.select("row", new.alias("new"))
    columns = [F.col("new").alias(c) if c == text_col else F.char_length("new").cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col("row")[c].alias(c) for c in docs.columns]
    return found.select(*columns)

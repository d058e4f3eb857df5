"""Each operator against its plain version, on awkward rows and on the small tables."""

from __future__ import annotations

import base64
import hashlib
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyfold.llm import base, bpe, chat, components, decontaminate, language_id, pii, quality_model, quality_rules, queries, simhash, substrings, toxicity
from tests.llm import brute

RANKS = public_tokenizers.path(queries.RANKS)
ODD = [
    None, "", " \n\t ", "a", "A b", "Éa é ß 漢字 😀𝄞 x", "one two three four five six seven eight nine ten eleven", "x " * 4000, "y" * 20000,
    "the same line\nthe same line\nthe same line\n\n", "mail a.b@c.de and 1.2.3.4, 300.1.1.1 or 4111 1111 1111 1111 +1 (555) 123-4567",
    "@@ a@b a@b.c_d@e.f 1.2.3.4.5.6.7.8 0004111111111111111 +12", "# * $ % & | < >", "\x00\x01 \x7f ok", "a\x0bb\x0cc\rd", "THE!! SAME!! " * 30,
]


def documents(spark, texts, extra=True):
    """Rows with clashing extra columns; the last text stands twice with one id."""
    rows = [(i, t, "en", i, "x") for i, t in enumerate([*texts])]
    rows.append(rows[-1])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, id long, words string")
    return df if extra else df.select("doc_id", "text")


def empty(spark):
    return documents(spark, ["a"]).filter("false")


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD).cache()


# 9


def test_quality_rules(spark, odd, small):
    for docs in (odd, small):
        got = quality_rules.verdicts(docs).collect()
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(got) == docs.count()
        for r in got:
            want = brute.quality(texts[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r["base_failed"] and r["kept"])
    assert quality_rules.verdicts(empty(spark)).isEmpty()
    kept = quality_rules.keep_documents(odd)
    assert kept.columns == odd.columns


def test_quality_ablations(small):
    led = quality_rules.ledger(small).cache()
    rows = led.select("failed").collect()
    masks = {r.name: 1 << r.bit for r in quality_rules.RULES}
    for r in quality_rules.ablations(led).collect():
        bit = masks[r["rule"]]
        assert r["n_failed"] == sum(bool(x[0] & bit) for x in rows)
        assert r["n_only"] == sum(x[0] == bit for x in rows)
        assert r["n_kept_without"] == sum(not x[0] & ~bit for x in rows)


# 3


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb")) if a}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, odd, small, reference):
    for docs in (odd, small):
        encoded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
        got = bpe.digests(bpe.decode(encoded, RANKS), keep=["decoded"]).collect()
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(got) == docs.count()
        for r in got:
            ids = reference.encode_ordinary(texts[r["doc_id"]] or "")
            assert r["n_tokens"] == len(ids)
            assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
    once = bpe.digests(bpe.encode(odd, RANKS, public_tokenizers.PATTERN, with_decoded=True)).collect()
    assert sorted(map(tuple, once)) == sorted(tuple(r) for r in bpe.digests(bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS)).collect())
    assert bpe.encode(empty(spark), RANKS, public_tokenizers.PATTERN).isEmpty()
    assert bpe.encode(odd, RANKS, public_tokenizers.PATTERN, as_array=True).schema["ids"].dataType.simpleString() == "array<int>"


def test_bpe_pieces(reference):
    ranks = bpe.read_ranks(RANKS)
    encoder = bpe.Encoder(ranks, *bpe.split_tokens(ranks))
    rnd, tokens = random.Random(1), list(ranks)
    for k in range(3000):
        piece = "".join(rnd.choices(tokens, k=5)) if k % 2 else "".join(rnd.choices("aehinorst", k=rnd.randint(1, 60)))
        want = reference._core_bpe.encode_single_piece(piece.encode("latin-1"))
        assert encoder.encode(piece) == want
    assert encoder.encode("ab" * 30000) == reference._core_bpe.encode_single_piece(b"ab" * 30000)


# 2


def test_decontamination(spark, odd, small, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    made = spark.createDataFrame(
        [(1, "two three FOUR, five six seven eight nine ten eleven"), (2, "a"), (3, None), (4, "same line"), (5, "x " * 12), (6, "zz " * 30), (7, "x"), (7, "Éa é")], "item_id long, text string"
    )
    for docs, items in ((small, bench), (odd, made), (small, made.filter("item_id = 6"))):
        pairs = [(r["item_id"], r["text"]) for r in items.collect()]
        rows = docs.select("doc_id", "text").collect()
        found = decontaminate.contamination(docs, items).collect()
        got = {r["doc_id"]: r for r in found}
        assert sorted(r["doc_id"] for r in found) == sorted(r["doc_id"] for r in rows)
        for r in rows:
            n, hit, found = brute.contamination(r["text"], pairs)
            g = got[r["doc_id"]]
            assert (g["n_words"], g["n_hit"], list(g["items"]), g["contaminated"]) == (n, hit, found, hit > 0)
    assert decontaminate.contamination(empty(spark), made).isEmpty()
    assert not decontaminate.contamination(small, made.filter("false")).filter("contaminated").count()
    assert decontaminate.drop_contaminated(odd, made).columns == odd.columns


# 8


@pytest.mark.parametrize("cap", [simhash.CAP, 3])
def test_simhash(spark, odd, small, cap):
    for docs in (odd, small):
        rows = docs.select("doc_id", "text").distinct().collect()
        fps = [brute.fingerprint(r["text"]) for r in rows]
        want = brute.components([r["doc_id"] for r in rows], fps)
        got = simhash.near_duplicates(docs, cap=cap).collect()
        assert len(got) == docs.count()
        by_id = {r["doc_id"]: f for r, f in zip(rows, fps, strict=True)}
        for r in got:
            assert r["fingerprint"] == f"{by_id[r['doc_id']]:016x}" and r["component_id"] == want[r["doc_id"]]
    assert simhash.near_duplicates(empty(spark)).isEmpty()


@pytest.mark.parametrize(("cap", "deal"), [(20000, simhash.FEW), (40, simhash.FEW), (5, simhash.FEW), (20000, simhash.MANY), (5, simhash.MANY)])
def test_near_links(spark, cap, deal):
    rng = random.Random(cap)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for centre in list(fps)[:4]:  # dense balls of fingerprints
        for _ in range(120):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    leaves = spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")
    links = simhash.near_links(leaves, cap=cap, deal=deal).cache()
    assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 3 for r in links.collect())
    want = brute.components(list(range(len(fps))), fps)
    got = {r["id"]: r["component"] for r in components.components(links).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == want
    assert links.count() < 4 * (4 if deal == simhash.FEW else 20) * len(fps)


def test_keep_one(odd):
    left = simhash.keep_one(odd)
    assert left.columns == odd.columns
    ids = [r["doc_id"] for r in left.collect()]
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()}
    assert sorted(ids) == sorted(d for d, c in found if d == c)


def test_keep_one_by_row(spark):
    """Null ids, and one id on two texts: one row stays of each group, and no group is lost."""
    rnd = random.Random(5)
    a, b, c, e, f = (" ".join("".join(rnd.choices("abcdefgh", k=6)) for _ in range(40)) for _ in range(5))
    f = f"{f} " * 20 + a
    near = next(t for t in (f"{f} {w}" for w in range(99)) if 0 < (brute.fingerprint(t) ^ brute.fingerprint(f)).bit_count() <= 3)
    schema = "doc_id long, text string"

    def kept(rows):
        return sorted(r["text"] for r in simhash.keep_one(spark.createDataFrame(rows, schema)).collect())

    assert kept([(None, a), (1, b), (1, b)]) == sorted([a, b])
    assert kept([(None, a), (None, b), (None, a)]) == sorted([a, b])
    assert kept([(1, a), (2, b), (2, a), (3, c), (3, e), (4, e)]) == sorted([a, b, c, e])
    assert kept([(5, a), (5, b), (6, a), (7, b)]) == sorted([a, b])
    assert len(kept([(None, f), (None, near)])) == 1
    got = simhash.near_duplicates(spark.createDataFrame([(None, a), (3, a), (3, b), (9, b), (None, c)], schema)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("3", "3"), ("3", "3"), ("9", "3"), ("None", "3"), ("None", "None")]
    assert len({r["fingerprint"] for r in got}) == 3


def test_clashing_columns(spark):
    """Columns named as those that the operators add, with rows that repeat."""
    passage = " ".join(f"word{k} of{k * k}" for k in range(120))
    columns = ("_id", "_hash", "_key_id", "_key_hash", "_spans", "row", "own_id", "id", "text_hash", "count", "at", "_at")
    rows = [(d, t, *[f"{d}{c}" for c in columns]) for d, t in ((1, passage), (1, passage), (2, passage + " and more of it"), (3, "quite another text"), (3, "quite another text"), (4, None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in columns))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted((r["doc_id"], r["_id"]) for r in kept.collect()) == [(i, f"{i}_id") for i in (1, 2, 3, 4)]
    cleaned = substrings.remove_repeats(docs, substrings.repeated_passages(docs))
    assert cleaned.columns == docs.columns and cleaned.count() == 6 and {r["_hash"] for r in cleaned.collect()} == {f"{d}_hash" for d in (1, 2, 3, 4)}
    assert min(len(r["text"]) for r in cleaned.filter("doc_id = 2").collect()) < len(passage) / 2
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, "quite another text")], "item_id long, text string"))
    assert left.columns == docs.columns and sorted(r["_key_id"] for r in left.collect()) == ["1_key_id", "1_key_id", "2_key_id", "4_key_id"]


def test_drop_contaminated_by_text(spark):
    item = "two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {item}"), (1, "clean"), (None, f"y {item} z"), (None, "fine"), (2, None)], "doc_id long, text string")
    left = decontaminate.drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(str(r["text"]) for r in left.collect()) == ["None", "clean", "fine"]


# 10


def test_personal_data(spark, odd, small):
    for docs in (odd, small):
        got = pii.personal_data(docs).select("id", *[F.size(k) for k in pii.PATTERNS], pii.span_list(list(pii.PATTERNS)).alias("s")).collect()
        texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert len(got) == docs.count()
        for r in got:
            counts, spans = brute.personal(texts[r["id"]])
            assert list(r)[1:5] == counts and r["s"] == ",".join(spans)
    assert pii.personal_data(empty(spark)).isEmpty()
    clean = pii.sanitise(odd)
    assert clean.columns == odd.columns
    out = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert out[0] is None and out[10] == "mail [email] and [ip], 300.1.1.1 or [card] [phone]" and out[5] == ODD[5]


def test_disclosing_terms(spark):
    """A name that stands near one number, in different surroundings, and nowhere else gives it away; common words don't."""
    rnd = random.Random(4)
    common = ["tree", "house", "river", "stone", "cloud", "bread", "music", "green"]
    texts = [" ".join(rnd.choices(common, k=12)) for _ in range(300)]
    for k in range(6):
        a, b = " ".join(rnd.choices(common, k=4)), " ".join(rnd.choices(common, k=4))
        texts[k] = f"{a} Zanzibor {common[k]} +1 555 123 4567 {b}"
    copy = "unusual wording here +1 555 999 0000 of one single text"
    texts += [copy] * 5  # copies are one piece of evidence
    docs = documents(spark, [*texts, None])
    found = pii.personal_data(docs)
    assert {r["id"]: r["spans"] for r in found.select("id", pii.span_list([*pii.PATTERNS, "term"]).alias("spans")).collect()} == brute.all_spans(dict(enumerate(texts)) | {len(texts): None})
    terms = found.filter("id < 6").select("id", "text", "term").collect()
    assert all({r["text"][t["start"] : t["end"]] for t in r["term"]} == {"Zanzibor"} for r in terms)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert "Zanzibor" not in clean[0] and "[phone]" in clean[0]


def test_terms_need_support(spark):
    """Planted words that reveal a number are found; words as rare that one text has near an entity, or copies of one, stay, however large the corpus is."""
    rnd = random.Random(14)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=6))
    common = [word() for _ in range(60)]
    prose = lambda n: " ".join(rnd.choices(common, k=n))
    telling, innocent, texts = [f"reveal{word()}" for _ in range(12)], [f"only{word()}" for _ in range(40)], []
    for k, t in enumerate(telling):
        texts += [f"{prose(9)} {t} +1 555 {100 + k} 4567 {prose(9)}" for _ in range(4)]
    texts += [f"{prose(9)} {x} a{k}@site{k % 5}.org {prose(9)}" for k, x in enumerate(innocent)]
    texts += [f"{prose(3)} onlycopied b@copied.net {prose(3)}"] * 30
    found = {}
    for size in (1000, 2000):
        docs = documents(spark, [*texts, *(prose(12) for _ in range(size - len(texts)))], extra=False)
        terms = pii.personal_data(docs).select("text", F.explode("term").alias("t")).select(F.lower(F.substring("text", F.col("t.start") + 1, F.col("t.end") - F.col("t.start"))).alias("w"))
        found[size] = {r["w"] for r in terms.distinct().collect()}
        assert len(found[size] & set(telling)) >= 0.9 * len(telling) and not found[size] & {*innocent, "onlycopied"}
    assert found[2000] <= found[1000] | set(common)


def test_terms_where_lower_case_is_longer(spark):
    """U+0130 becomes two characters in lower case: terms after it, and terms that start with it, are found in their places."""
    rnd = random.Random(4)
    common = ["tree", "house", "river", "stone", "cloud", "bread", "music", "green"]
    texts = [" ".join(rnd.choices(common, k=12)) for _ in range(300)]
    for k in range(6):
        a, b = " ".join(rnd.choices(common, k=4)), " ".join(rnd.choices(common, k=4))
        texts[k] = f"\u0130\u0130 {a} \u0130zmirli {common[k]} +1 555 123 4567 Zanzibor {b}"
    docs = documents(spark, texts)
    terms = pii.personal_data(docs).filter(F.size("term") > 0).select("id", "text", "term").collect()
    assert {r["id"] for r in terms} == set(range(6))
    assert {r["text"][t["start"] : t["end"]] for r in terms for t in r["term"]} == {"\u0130zmirli", "\u0130\u0130", "Zanzibor"}
    clean = [r["text"] for r in pii.sanitise(docs).filter("doc_id < 6").collect()]
    assert not any("zmirli" in t or "Zanzibor" in t for t in clean) and all("[phone]" in t for t in clean)


# 1


def test_passages(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyzé", k=rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(60)
    texts = [prose(200) for _ in range(20)]
    texts[3] = texts[3][:500] + shared + texts[3][500:]
    texts[7] = prose(3) + shared + prose(30)
    texts[9] = prose(30) + shared
    inner = prose(60)
    texts[11] = inner + " " + prose(10) + " " + inner  # repeats within one document alone
    docs = documents(spark, [*texts, None, ""])
    found = substrings.repeated_passages(docs).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["n_chunks"], r["run_words"], r["run_bytes"], r["first_id"], r["is_first"]) for r in found) == brute.passages(texts, substrings.borders)
    assert {r["doc_id"] for r in found} == {3, 7, 9}
    for r in found:
        assert texts[r["doc_id"]][r["start"] : r["end"]] in shared and r["is_first"] == (r["doc_id"] == 3)
    cleaned = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(docs, substrings.repeated_passages(docs)).collect()}
    assert cleaned[3] == texts[3] and len(cleaned[7]) < len(texts[7]) - 180 and cleaned[20] is None
    assert substrings.repeated_passages(empty(spark)).isEmpty()


def test_passages_by_row(spark):
    """One id on two texts, null ids and repeated rows: every text keeps what it alone holds."""
    rnd = random.Random(6)
    prose = lambda n: " ".join("".join(rnd.choices("abcdefghijklm", k=rnd.randint(2, 9))) for _ in range(n))
    shared, own, other, third = prose(60), prose(90), prose(80), prose(70)
    rows = [(1, f"{own} {shared}"), (1, other), (2, f"{third} {shared}"), (2, f"{third} {shared}"), (None, f"{shared} {prose(9)}"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeated_passages(docs)
    assert sorted((str(r["doc_id"]), r["first_id"], r["is_first"]) for r in found.collect()) == [("1", 1, True), ("2", 1, False), ("None", 1, False)]
    left = substrings.remove_repeats(docs, found).collect()
    assert len(left) == len(rows) and {rows[0][1], other} <= {r["text"] for r in left}
    assert all(third in r["text"] and len(r["text"]) < len(third) + 120 for r in left if r["doc_id"] == 2)


@pytest.mark.parametrize("again", ["word ", "A ", "x", "fünf ", "ab\n"])
def test_repetitions_are_cut_alike(spark, again):
    """A stretch of one thing over and over is found wherever it begins and however long it goes on."""
    rnd = random.Random(2)
    prose = lambda n: " ".join("".join(rnd.choices("cdefghijklm", k=rnd.randint(2, 9))) for _ in range(n))
    texts = [f"{prose(30)}\n{again * 600}{prose(20)}", f"{prose(41)} {again * 1170}", again * 651 + prose(50), prose(90)]
    raws = [t.encode() for t in texts]
    cuts = [substrings.borders(r) for r in raws]
    assert all(c[0] == 0 and c[-1] == len(r) and np.diff(c).max() <= 128 for c, r in zip(cuts, raws, strict=True))
    found = substrings.repeated_passages(documents(spark, texts)).collect()
    assert sorted((r["doc_id"], r["start"], r["end"], r["n_chunks"], r["run_words"], r["run_bytes"], r["first_id"], r["is_first"]) for r in found) == brute.passages(texts, substrings.borders)
    for i, n in enumerate((600, 1170, 651)):
        mine = sum(r["end"] - r["start"] for r in found if r["doc_id"] == i)
        assert n * len(again) - 120 <= mine <= n * len(again)


def test_chunks_cover_the_text(spark, odd):
    rows = substrings.chunks(odd.dropDuplicates(["doc_id"])).orderBy("id", "start").collect()
    for i, t in enumerate(ODD):
        own = [r for r in rows if r["id"] == i]
        assert "".join((t or "")[r["start"] : r["end"]] for r in own) == (t or "")


def test_borders_move_with_the_text():
    rnd = random.Random(3)
    text = "".join(rnd.choices("abcdefg hijk", k=5000)).encode()
    a, b = substrings.borders(text), substrings.borders(b"inserted words " + text)
    assert len({x + 15 for x in a} & set(b)) > 0.97 * len(a)
    big = bytes(rnd.choices(range(97, 123), k=3_000_000))
    block, substrings.BLOCK_BYTES = substrings.BLOCK_BYTES, 1 << 22
    whole = substrings.borders(big)
    substrings.BLOCK_BYTES = block
    assert np.array_equal(whole, substrings.borders(big))


# 5, 6, 7


def _fold(spark, sf_dir, sf="sf0.01"):
    folder = sf_dir.replace("sf0.001", sf)
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def auc(rows):
    """Share of pairs of a positive and a negative in the right order; equal scores count half."""
    pos, neg = np.array([s for s, y in rows if y == 1]), np.array([s for s, y in rows if y == 0])
    return ((pos[:, None] > neg).mean() + (pos[:, None] >= neg).mean()) / 2


def test_language(spark, odd, sf_dir):
    docs, _ = _fold(spark, sf_dir)
    model = language_id.fit(docs.filter(~queries.held_out()))
    test = docs.filter(queries.held_out())
    right = language_id.predict(test, model).join(test.select("doc_id", "lang"), "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == ("und", 0.0) and got[12][0] == "und" and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.predict(odd, language_id.fit(empty(spark))).filter("lang_pred != 'und'").isEmpty()
    assert language_id.predict(empty(spark), model).isEmpty()
    signs = documents(spark, ["\u00bd \u00b2 \u2167", "12 \u0663", "_"])
    assert {r["lang_pred"] for r in language_id.predict(signs, model).collect()} == {"und"}


def test_language_backs_off():
    model = language_id.Model(["a", "b"], {"known": np.array([-1.0, -9.0])}, {"zz": np.array([-9.0, -1.0]), "q": np.array([-1.0, -3.0])})
    s = language_id.Scorer(model)
    assert s.score("known")[0] == "a" and s.score("zzz")[0] == "b" and s.score("xqx")[0] == "a"
    for text in ("known zzz", "q xqx known Known", "azzq\u00bdzz", "nothing"):
        want = brute.language(text, model.languages, model.words, model.grams)
        assert s.score(text)[0] == want[0] and np.isclose(s.score(text)[1], want[1])


def test_toxicity(spark, odd, sf_dir):
    docs, labels = _fold(spark, sf_dir, "sf0.1")  # some hundred toxic documents to learn from
    model = toxicity.fit(docs.filter(~queries.held_out()), labels)
    got = toxicity.predict(docs.filter(queries.held_out()), model).join(labels, "doc_id").select("score", "toxic").collect()
    assert auc(got) > 0.85
    found = [r for r in got if r[0] >= 0.3]
    assert np.mean([r[1] for r in found]) > 0.8 and sum(r[1] for r in found) > 0.7 * sum(r[1] for r in got)
    rows = toxicity.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len(toxicity.predict(odd, toxicity.fit(empty(spark), labels)).collect()) == odd.count()


def test_toxicity_ablation(spark, sf_dir):
    """On held-out rows, misspelt terms are caught by the automata alone, and quotation marks take a score back."""
    docs, labels = _fold(spark, sf_dir, "sf0.1")
    model = toxicity.fit(docs.filter(~queries.held_out()), labels)
    w = dict(zip(toxicity.FEATURES, model.weights, strict=False))
    assert min(w["exact"], w["one_edit"], w["two_edits"], w["weight"]) > 0 > w["quoted"]
    matcher, kinds = toxicity.Matcher(model.lexicon), {}
    rows = docs.filter(queries.held_out()).join(labels.filter("toxic = 1"), "doc_id").select("doc_id", "text").collect()
    for r in rows:
        found = toxicity.spans(r["text"], matcher)
        for text, y in toxicity.variants(r["text"], found, model.lexicon) if found else []:
            kinds.setdefault(y, []).append(text)
            x = np.array(toxicity.features(toxicity.spans(text, matcher), len(text), model.lexicon, model.context))
            assert 0 <= 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1]))) <= 1
    score = lambda texts, m: [r["score"] for r in toxicity.predict(documents(spark, texts), m).collect()][:-1]
    exact_only = toxicity.Model(model.lexicon, model.context, model.weights * np.array([f not in ("one_edit", "two_edits") for f in (*toxicity.FEATURES, "bias")]))
    caught, without = (np.mean(np.array(score(kinds[1], m)) >= 0.3) for m in (model, exact_only))
    assert caught > 0.8 and caught > without
    assert np.mean(np.array(score(kinds[0], model)) < 0.3) > 0.9
    one = score(kinds[1][:1], model)[0]
    x = np.array(toxicity.features(toxicity.spans(kinds[1][0], matcher), len(kinds[1][0]), model.lexicon, model.context))
    assert np.isclose(one, 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1]))))
    assert toxicity.predict(empty(spark), model).isEmpty()


def test_fuzzy_lexicon():
    terms = ["loser", "idiot", "pathetic", "scum", "worthless", "lose"]
    lexicon, rnd = toxicity.FuzzyLexicon(terms), random.Random(0)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    for _ in range(1500):
        w = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            i = rnd.randrange(len(w) + 1)
            w[i : i + rnd.randint(0, 1)] = rnd.choices("loseridtxé", k=rnd.randint(0, 1))
        word = "".join(w)
        near = [(distance(word, t), i) for i, t in enumerate(terms) if distance(word, t) <= toxicity.allowed_edits(t)]
        assert lexicon.match(word) == min(near, default=None)


def test_toxic_context():
    lexicon = toxicity.Lexicon(["idiot"], [3.0], [1.0], frozenset({"idiom"}))
    matcher = toxicity.Matcher(lexicon)
    quoted = lambda t: toxicity.spans(t, matcher)[0].quoted
    assert quoted('he said "idiot" once') and quoted("the “idiot” there") and not quoted("what an idiot") and not quoted('"a" what an idiot "b"')
    assert toxicity.spans("an idi0t", matcher)[0].edits == 1 and not toxicity.spans("an idiom", matcher)
    assert toxicity.spans("a b c d e f g idiot h", matcher)[0].window == ["b", "c", "d", "e", "f", "g", "h"]
    copies = toxicity.variants("what an idiot", toxicity.spans("what an idiot", matcher), lexicon)
    assert copies[0] == ('what an "idiot"', 0) and copies[1][1] == 1 and toxicity.spans(copies[1][0], matcher)[0].edits == 1


def test_quality_model(spark, odd, sf_dir):
    docs, labels = _fold(spark, sf_dir)
    model = quality_model.fit(docs.filter(~queries.held_out()), labels)
    got = quality_model.predict(docs.filter(queries.held_out()), model).join(labels, "doc_id").select("score", "quality").collect()
    assert auc(got) > 0.95
    rows = quality_model.predict(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len(quality_model.predict(odd, quality_model.fit(empty(spark), labels)).collect()) == odd.count()
    assert quality_model.predict(empty(spark), model).isEmpty()


def test_quality_features():
    """Hashed words and character n-grams as a plain loop finds them, on characters of any width."""
    for text in ("Éa é ß 漢字 😀𝄞 x", "one two two\tthree", "a", "", " \n ", "ab  ab"):
        want = brute.subwords(text, quality_model)
        at, n = quality_model.counted(text)
        assert dict(zip(at.tolist(), n.tolist(), strict=True)) == want
    model = quality_model.Model(np.random.default_rng(1).normal(size=quality_model.BUCKETS), -0.2)
    want = brute.subwords("one two two", quality_model)
    logit = -0.2 + sum(model.scores[b] * n for b, n in want.items()) / sum(want.values())
    assert np.isclose(model.logits(["one two two"])[0], logit)


def test_quality_scores_stand_alone():
    """A text's score doesn't depend on its neighbours in a batch, or on where numpy's blocks end."""
    model = quality_model.Model(np.random.default_rng(0).normal(size=quality_model.BUCKETS), 0.1)
    texts = ["some words here here", None, "", "other words", "x" * 50, "a b " * 900]
    together = model.logits(texts)
    assert np.allclose(together, [model.logits([t])[0] for t in texts])
    block, quality_model.BLOCK_CHARS = quality_model.BLOCK_CHARS, 200
    assert np.allclose(model.logits(texts[:5]), together[:5])
    quality_model.BLOCK_CHARS = block


# 4


def test_chat(spark):
    schemas = {"f": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}}, "additionalProperties": False}}
    call = lambda c, i, t, a, name="f": (c, i, t, name, a if a is None or isinstance(a, str) else json.dumps(a))
    ref = lambda i: {"n": {"$ref": i}}
    calls = spark.createDataFrame(
        [
            call(1, "a", 1, {"n": 2.0}), call(1, "a", 9, {"n": 5}), call(1, "b", 2, ref("a")), call(1, "c", 3, ref("b")), call(1, "d", 4, ref("nowhere")),
            call(1, "e", 5, ref("f")), call(1, "f", 6, ref("e")), call(1, "g", 7, {"n": 0}), call(1, "h", 8, "{bad"), call(1, "i", 8, {"n": 1}, "unknown"),
            call(2, "a", 1, '{"n":1,"n":2}'), call(2, None, 1, {"n": 1}), call(2, "z", 1, None), call(2, "long", 3, '{"n":' + "[" * 3000 + "]" * 3000 + "}"),
        ],
        "conv_id long, call_id string, turn long, name string, arguments string",
    )
    results = spark.createDataFrame([(1, "a", 2, 'x"é'), (1, "a", 3, "later"), (1, "b", 3, "y"), (3, "q", 1, None)], "conv_id long, call_id string, turn long, content string")
    got = {(r["conv_id"], r["call_id"]): r for r in chat.link(calls.withColumn("content", F.lit(1)), results.withColumn("name", F.lit(1)), schemas).collect()}
    status = {k: r["status"] for k, r in got.items()}
    assert status == {
        (1, "a"): "ok", (1, "b"): "ok", (1, "c"): "no_result", (1, "d"): "missing_reference", (1, "e"): "cyclic", (1, "f"): "cyclic", (1, "g"): "invalid", (1, "h"): "invalid",
        (1, "i"): "invalid", (2, "a"): "invalid", (2, None): "no_id", (2, "z"): "invalid", (2, "long"): "invalid", (3, "q"): "orphan_result",
    }
    assert got[1, "a"]["record"] == '{"arguments":{"n":2},"id":"a","name":"f","result":"x\\"é"}'
    assert (got[1, "a"]["n_calls"], got[1, "a"]["n_results"], got[1, "a"]["level"], got[1, "c"]["level"]) == (2, 2, 0, 2)
    assert chat.link(calls.filter("false"), results.filter("false"), schemas).isEmpty()


def test_chat_long_chains(spark):
    """Levels of a chain of 1500 calls, of calls with several references over chains, and of circles that chains lead to."""
    edges = [(1, f"c{k}", f"c{k - 1}") for k in range(1, 1500)] + [(1, "m", "c1499"), (1, "m", "c7"), (1, "n", "m"), (1, "o", "n"), (1, "o", "c3")]
    edges += [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "d", "a"), (2, "e", "d"), (2, "f", "e"), (2, "f", "g"), (2, "h", "g")]
    names = sorted({(c, x) for c, *xs in edges for x in xs} | {(3, "alone")})
    calls = spark.createDataFrame(names, "conv_id long, call_id string")
    found = chat.levels(calls, spark.createDataFrame(edges, "conv_id long, call_id string, ref string")).collect()
    got = {(r["conv_id"], r["call_id"]): r["level"] for r in found}
    want = {(1, f"c{k}"): k for k in range(1500)} | {(1, "m"): 1500, (1, "n"): 1501, (1, "o"): 1502, (2, "g"): 0, (2, "h"): 1, (3, "alone"): 0}
    assert got == want and len(found) == len(want)


def test_chat_repeated_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1, "assistant", "y"), (2, 0, "user", None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.link(*chat.turns_as_calls(turns), chat.SCHEMAS).collect()}
    assert (got[1]["n_calls"], got[1]["n_results"], got[1]["status"], got[2]["status"]) == (2, 3, "ok", "invalid")
    assert json.loads(got[1]["record"]) == {"arguments": {"limit": 1, "query": "a"}, "id": "call_0", "name": "search", "result": "x"}


def test_chat_canonical():
    assert chat.canonical(json.loads('{"b": 1.0, "a": [1e3, "é", null, true], "c": {"y": 2, "x": 1.5}}')) == '{"a":[1000,"é",null,true],"b":1,"c":{"x":1.5,"y":2}}'
    with pytest.raises(ValueError):
        chat.parse('{"a":NaN}')


def test_chat_query(spark, sf_dir):
    """One call for each user turn; orders put every call after those that it refers to."""
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = queries.op4_chat(spark, sf_dir).collect()
    users = {(r["conv_id"], r["turn"]): r["text"] for r in conv.filter("role = 'user'").collect()}
    replies = {(r["conv_id"], r["turn"]): r["text"] for r in conv.filter("role = 'assistant'").collect()}
    calls = {(r["conv_id"], r["call_id"]): r for r in rows}
    assert len([r for r in rows if r["n_calls"]]) == len(users)
    for r in rows:
        if not r["n_calls"]:
            assert r["status"] == "orphan_result"
            continue
        record = json.loads(r["record"])
        assert record["arguments"]["query"] == users[r["conv_id"], r["turn"]]
        assert record.get("result") == replies.get((r["conv_id"], r["turn"] + 1))
        if r["status"] in ("ok", "no_result") and "context" in record["arguments"]:
            assert calls[r["conv_id"], record["arguments"]["context"]["$ref"]]["level"] < r["level"]


# all


def test_very_long_text(spark, reference):
    """A text of several MB, with many matches, beside an empty one."""
    rnd = random.Random(8)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(5000)]
    long = "\n".join(" ".join(rnd.choices(words, k=12)) + " a.b@c.example.com" for _ in range(40000))
    docs = documents(spark, [long, ""])
    assert len(long) > 3_000_000
    got = {r["id"]: r for r in pii.personal_data(docs).select("id", F.size("email").alias("n"), pii.span_list(["email"]).alias("s")).collect()}
    assert got[0]["n"] == 40000 and got[0]["s"] == ",".join(f"email:{x.start()}:{x.end()}" for x in re.finditer(brute.PII["email"], long))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0].count("[email]") == 40000 and "@" not in clean[0] and clean[1] == ""
    assert quality_rules.verdicts(docs).filter("doc_id = 0").first()["n_words"] == 40000 * 13
    ids = reference.encode_ordinary(long)
    assert bpe.digests(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, with_decoded=True)).filter("doc_id = 0").first()["n_tokens"] == len(ids)
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {0, 1}
    item = spark.createDataFrame([(1, " ".join(brute.WORD.findall(long)[100:112]))], "item_id long, text string")
    assert decontaminate.contamination(docs, item).filter("doc_id = 0").first()["n_hit"] == 12
    assert len(substrings.chunks(docs).filter("id = 0").select("start").collect()) > 50_000
    model = quality_model.Model(np.ones(quality_model.BUCKETS), 0.0)
    assert np.isclose(model.logits([long])[0], 1.0)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 1000])
def test_running(spark, n):
    """Sums and maxima over blocks as one by one."""
    x = [random.Random(n + k).randint(0, 99) for k in range(n)]
    df = spark.createDataFrame([(x,)], "x array<int>")
    got = df.select(base.running(F.col("x")).alias("s"), base.running(F.col("x"), F.greatest).alias("m")).first()
    assert got["s"] == [sum(x[:k]) for k in range(n + 1)] and got["m"] == [max([0, *x[:k]]) for k in range(n + 1)]


# components


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 120)] + [(rnd.randint(200, 400), rnd.randint(200, 400)) for _ in range(120)] + [(500, 500 + k) for k in range(1, 80)]
    want = {}
    label = {x: x for p in pairs for x in p}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        label[max(x, y)] = min(x, y)
    want = {x: top(x) for p in pairs if p[0] != p[1] for x in p}
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == want

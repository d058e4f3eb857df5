"""One query for each text operator, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import bpe, centroids, chat, decontaminate, fill_middle, language_id, line_dedup, pii, quality_model, quality_rules, simhash, substrings, toxicity
from tallyfold.llm.base import held_out, table

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, with_decoded=True))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link(*chat.turns_as_calls(table(spark, sf_dir, "conversations")), chat.SCHEMAS)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(~held_out()))
    return language_id.predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs.filter(~held_out()), table(spark, sf_dir, "labels"))
    scored = toxicity.predict(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model.fit(docs.filter(~held_out()), table(spark, sf_dir, "labels"))
    scored = quality_model.predict(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.verdicts(table(spark, sf_dir, "documents"))
    # Rules without any one of which the document would be kept, as bits: all if none failed, that one if one did.
    alone = F.when(F.col("failed") == 0, F.lit(quality_rules.ALL)).when(F.bit_count("failed") == 1, F.col("failed")).otherwise(0).cast("long")
    return d.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "failed", alone.alias("kept_without"), "policy")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.all_ablations(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = list(pii.PATTERNS)
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(pii.span_list(base).cast("binary"), 256).alias("base_sha256"),
        pii.span_list([*base, "term"]).alias("spans"),
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fill_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda x, name: F.sha2(x.cast("binary"), 256).alias(name)
    return d.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output"), "output_sha256"), digest(fill_middle.restored(F.col("output"), F.col("form")), "restored_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_substrings": op1_substrings,
    "op2_decontaminate": op2_decontaminate,
    "op3_bpe": op3_bpe,
    "op4_chat": op4_chat,
    "op5_language_id": op5_language_id,
    "op6_toxicity": op6_toxicity,
    "op7_quality_model": op7_quality_model,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "op10_pii": op10_pii,
    "op11_fill_middle": op11_fill_middle,
    "op12_line_dedup": op12_line_dedup,
    "op13_centroids": op13_centroids,
    "rule_ablations": rule_ablations,
}

#: The space that separates words for the rules, and the words that decontamination takes.
_SPACE, _WORD = r"[\x20\x09-\x0D]", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_COUNT = "CAST(length(regexp_replace(t, '[^{}]', '', 'g')) AS BIGINT)"

_LEDGER = rf"""WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x != '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY 1),
m AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}', '', 'g')) AS BIGINT) AS word_chars, {_COUNT.format('#*$%&|<>')} AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    {_COUNT.format('!')} AS n_exclamations, {_COUNT.format(r'\p{L}')} AS n_letters, {_COUNT.format(r'\p{Lu}')} AS n_capitals
  FROM s LEFT JOIN rep USING (rid)),
f AS (SELECT *, CAST({' + '.join(f'CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END' for r in quality_rules.RULES)} AS BIGINT) AS failed FROM m)"""
_OP9 = rf"""{_LEDGER}
SELECT doc_id, {', '.join(quality_rules.MEASURES)}, failed & 3 != 0 AS base_failed, failed = 0 AS kept, failed,
  CAST(CASE WHEN failed = 0 THEN {quality_rules.ALL} WHEN bit_count(failed) = 1 THEN failed ELSE 0 END AS BIGINT) AS kept_without, 'web-1' AS policy FROM f"""

_POLICY_RULES = ", ".join(f"('{p}', '{r.name}', {1 << r.bit}, {sum(1 << x.bit for x in quality_rules.RULES if x.name in names)})" for p, names in quality_rules.POLICIES.items() for r in quality_rules.RULES if r.name in names)
_ABLATIONS = rf"""{_LEDGER}, p AS (SELECT * FROM (VALUES {_POLICY_RULES}) t(policy, rule, bit, mask))
SELECT policy, rule, count(*) FILTER (WHERE failed & bit != 0) AS n_failed, count(*) FILTER (WHERE failed & mask = bit) AS n_only, count(*) FILTER (WHERE failed & mask & ~bit = 0) AS n_kept_without
FROM f CROSS JOIN p GROUP BY 1, 2"""

_OP2 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER.format('text')}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, '{_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b) WHERE n > 0)),
places AS (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hits AS (SELECT rid, i, p.n, item_id FROM places p JOIN bw ON bw.win = array_to_string(w[i:i + p.n - 1], ' ') AND bw.n = p.n),
n_hit AS (SELECT rid, count(DISTINCT k) AS n FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY 1),
its AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(its.list, '')) AS items_sha256, coalesce(n_hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (rid) LEFT JOIN its USING (rid)"""

_OP4 = """WITH RECURSIVE u AS (
  SELECT conv_id, turn, turn // 2 AS k, arg_min(q, CAST(to_json(q) AS VARCHAR)) AS q, count(*) AS n FROM (SELECT conv_id, turn, coalesce(text, '') AS q FROM conversations WHERE role = 'user') GROUP BY 1, 2),
a AS (SELECT conv_id, turn, CASE WHEN count(*) = count(text) THEN min(text) END AS content, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
c AS (SELECT conv_id, turn, 'call_' || turn AS call_id, CASE WHEN k > 0 THEN k // 2 * 2 + turn % 2 END AS refers, ['search', 'summarise', 'translate'][k % 3 + 1] AS name, q, n FROM u),
e AS (SELECT c.*, c.refers IS NOT NULL AND t.turn IS NULL AS missing, t.turn AS ref FROM c LEFT JOIN c t ON t.conv_id = c.conv_id AND t.turn = c.refers),
lv AS (SELECT conv_id, turn, 0 AS level FROM e WHERE ref IS NULL UNION ALL SELECT e.conv_id, e.turn, lv.level + 1 FROM e JOIN lv ON lv.conv_id = e.conv_id AND lv.turn = e.ref),
r AS (
  SELECT coalesce(e.conv_id, a.conv_id) AS conv_id, coalesce(e.call_id, 'call_' || (a.turn - 1)) AS call_id, e.name, coalesce(e.turn, a.turn) AS turn, lv.level,
    coalesce(e.n, 0) AS n_calls, coalesce(a.n, 0) AS n_results, e.turn IS NOT NULL AND e.q = '' AS invalid, e.missing, e.refers, e.q, a.content
  FROM e LEFT JOIN lv ON lv.conv_id = e.conv_id AND lv.turn = e.turn FULL JOIN a ON a.conv_id = e.conv_id AND a.turn - 1 = e.turn)
SELECT conv_id, call_id, name, turn, CAST(level AS INTEGER) AS level, n_calls, n_results,
  CASE WHEN n_calls = 0 THEN 'orphan_result' WHEN invalid THEN 'invalid' WHEN missing THEN 'missing_reference' WHEN level IS NULL THEN 'cyclic' WHEN n_results = 0 THEN 'no_result' ELSE 'ok' END AS status,
  '{' || concat_ws(',',
    CASE WHEN n_calls > 0 THEN '"arguments":{' || CASE WHEN refers IS NOT NULL THEN '"context":{"$ref":"call_' || refers || '"},' ELSE '' END || '"limit":' || len(string_split(q, ' ')) || ',"query":' || CAST(to_json(q) AS VARCHAR) || '}' END,
    '"id":"' || call_id || '"', CASE WHEN name IS NOT NULL THEN '"name":"' || name || '"' END,
    CASE WHEN invalid THEN '"problem":"$.query: length out of bounds"' END, CASE WHEN content IS NOT NULL THEN '"result":' || CAST(to_json(content) AS VARCHAR) END) || '}' AS record
FROM r"""

_OP11 = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (
  SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:n], '') AS s FROM c),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END AS o FROM p)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form != 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars, sha256(o) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN o
    WHEN 'psm' THEN split_part(split_part(o, '<P>', 2), '<S>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<M>', 1)
    ELSE split_part(split_part(o, '<P>', 2), '<M>', 1) || split_part(o, '<M>', 2) || split_part(split_part(o, '<S>', 2), '<P>', 1) END) AS restored_sha256
FROM o"""

_OP12 = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
k AS (SELECT *, {_LOWER.format(rf"regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g')")} AS key FROM x),
often AS (SELECT key FROM k WHERE key != '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(often.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE often.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN often USING (key) GROUP BY rid"""


def _lloyd(k: int, dims: int, rounds: int, scale: int) -> str:
    ctes = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, q) - 1 AS k, q FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, q FROM v ORDER BY h, q LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        # The squared distance times 64 and the centroid's number, so that the smaller number wins a tie.
        ctes.append(f"a{r} AS MATERIALIZED (SELECT rid, min(CAST(list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, c.q) + list_inner_product(c.q, c.q) AS BIGINT) * 64 + c.k) AS m FROM v CROSS JOIN c{r} c GROUP BY rid)")
        if r < rounds:
            ctes.append(f"s{r} AS MATERIALIZED (SELECT k, list(floor(s / n) ORDER BY j) AS q FROM (SELECT a{r}.m % 64 AS k, j, sum(q[j]) AS s, count(*) AS n FROM a{r} JOIN v USING (rid) CROSS JOIN range(1, {dims + 1}) t(j) GROUP BY 1, 2) GROUP BY k)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(s.q, c.q) AS q FROM c{r} c LEFT JOIN s{r} s USING (k))")
    return f"""WITH {', '.join(ctes)},
n AS (SELECT k, sha256(array_to_string(list_transform(q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS h FROM c{rounds})
SELECT vec_id, CAST(m % 64 AS INTEGER) AS cluster, m // 64 AS distance, CAST(sum(m // 64) OVER (PARTITION BY m % 64) AS BIGINT) AS cluster_inertia, CAST(sum(m // 64) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN v USING (rid) JOIN n ON n.k = m % 64"""


#: The others are beyond SQL (see README); tests/llm holds them against plain versions.
ORACLES: dict[str, str] = {
    "op2_decontaminate": _OP2,
    "op4_chat": _OP4,
    "op9_quality_rules": _OP9,
    "rule_ablations": _ABLATIONS,
    "op11_fill_middle": _OP11,
    "op12_line_dedup": _OP12,
    "op13_centroids": _lloyd(centroids.K, centroids.DIMS, centroids.ROUNDS, centroids.SCALE),
}

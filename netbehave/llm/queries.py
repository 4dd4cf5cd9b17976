"""Queries of this package over the driver's tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netbehave.llm import (
    audit,
    decontam,
    langid,
    linkgraph,
    lm,
    neardup,
    orchard,
    pieces,
    pii,
    quality,
    secretscan,
    tokencount,
    tokenfile,
)
from netbehave.llm.words import shared_folder, table

END_OF_TEXT = 49_407  # last id of the word tokenizer
PII_KEY = b"key of the registered query"
URL_RULES = [
    ("block", "net/"),
    ("allow", "example.net/en/"),
    ("block", "example.com/de/"),
    ("allow", "org/fr/"),
]


def word_tokenizer() -> str:
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        return file.read()


def op1_suffix_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(table(spark, sf_dir, "documents"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tokenfile.token_digests(docs, shared_folder(spark, "tokens"), word_tokenizer())


def op3_simhash_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return decontam.contamination(docs, table(spark, sf_dir, "benchmark"))


def op4_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = pieces.read_pieces(spark, public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encoded(table(spark, sf_dir, "documents"), known)


def op5_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secretscan.find_secrets(docs, secretscan.fit(docs))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(table(spark, sf_dir, "documents"), PII_KEY)


def op7_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op8_word_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.remainder(4) == 2, F.lit(False))
    identifier = langid.fit(docs.where(~held_out))
    found = langid.predict(docs, identifier)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(langid.remainder(7) == 2, F.lit(False))
    found = lm.score(docs, ~held_out, word_tokenizer(), END_OF_TEXT)
    return found.withColumn("held_out", held_out)


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = tokencount.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents")
    return tokencount.section_counts(docs, tokens, public_tokenizers.PATTERN)


def op11_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkgraph.judged_pages(table(spark, sf_dir, "pages"), URL_RULES)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


def op13_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.coded(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_quality": op1_suffix_quality,
    "op2_token_files": op2_token_files,
    "op3_simhash_leaks": op3_simhash_leaks,
    "op4_piece_lattice": op4_piece_lattice,
    "op5_secret_spans": op5_secret_spans,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_bbit_minhash": op7_bbit_minhash,
    "op8_word_languages": op8_word_languages,
    "op9_attention_scores": op9_attention_scores,
    "op10_section_tokens": op10_section_tokens,
    "op11_host_trust": op11_host_trust,
    "op12_filter_audit": op12_filter_audit,
    "op13_orchard_codes": op13_orchard_codes,
}

# Repeated sequences as runs on diagonals: equal MIN_REPEAT-word windows at i and i + d.
OP1_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id
), place AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM texts
), three AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+2]) AS n
    FROM place WHERE i + 2 <= len(w)) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM three) GROUP BY doc_id
), many AS (
  SELECT doc_id, i, g FROM (
    SELECT doc_id, i, w[i:i+{quality.MIN_REPEAT - 1}] AS g,
           count(*) OVER (PARTITION BY doc_id, w[i:i+{quality.MIN_REPEAT - 1}]) AS n
    FROM place WHERE i + {quality.MIN_REPEAT - 1} <= len(w)) WHERE n > 1
), cov AS (
  SELECT doc_id, count(DISTINCT p) AS n
  FROM (SELECT doc_id, unnest(range(i, i + {quality.MIN_REPEAT})) AS p FROM many) GROUP BY doc_id
), diagonal AS (
  SELECT a.doc_id, b.i - a.i AS d,
         a.i - row_number() OVER (PARTITION BY a.doc_id, b.i - a.i ORDER BY a.i) AS run
  FROM many a JOIN many b ON a.doc_id = b.doc_id AND a.g = b.g AND a.i < b.i
), longest AS (
  SELECT doc_id, max(n) + {quality.MIN_REPEAT - 1} AS n
  FROM (SELECT doc_id, count(*) AS n FROM diagonal GROUP BY doc_id, d, run) GROUP BY doc_id
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(cov.n, 0)::BIGINT AS covered_words, coalesce(longest.n, 0)::BIGINT AS longest_repeat
  FROM texts LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)
  LEFT JOIN cov USING (doc_id) LEFT JOIN longest USING (doc_id)
), judged AS (
  SELECT *, n_words < {quality.MIN_WORDS}
    OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base
)
SELECT *, NOT base_failed AND 100 * covered_words <= {quality.MAX_COVERED_PERCENT} * n_words
  AND longest_repeat <= {quality.MAX_LONGEST} AS kept
FROM judged
"""



def rule_sql(columns: str, value: int) -> str:
    """Verdict (0) or text (1) of the longest rule that fits, from columns host and path."""
    cases = []
    for rule in sorted(URL_RULES, key=lambda one: -len(one[1])):
        host, slash, path = rule[1].partition("/")
        fits = f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}')"
        cases.append(f"WHEN {fits} THEN '{rule[value]}'")
    return f"CASE {' '.join(cases)} END AS {columns}"


LINK_SQL = linkgraph.LINK.replace("'", "''")

OP11_SQL = f"""
WITH RECURSIVE rest AS (
  SELECT page_id, html, coalesce(CASE WHEN position('://' IN url) > 0
    THEN substring(url, position('://' IN url) + 3) ELSE '' END, '') AS rest FROM pages
), placed AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{linkgraph.UPPER}', '{linkgraph.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), ruled AS (
  SELECT page_id, host, path, {rule_sql("rule", 1)}, {rule_sql("by_rule", 0)} FROM placed
), hosts AS (
  SELECT host, count(*) AS n_pages, count(*) FILTER (by_rule = 'allow') AS trust,
         count(*) FILTER (by_rule = 'block') AS distrust FROM ruled GROUP BY host
), links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, unnest(list_distinct(list_transform(regexp_extract_all(html, '{LINK_SQL}', 1),
           lambda x: translate(x, '{linkgraph.UPPER}', '{linkgraph.LOWER}')))) AS dst
    FROM placed WHERE host <> '' AND html IS NOT NULL)
  WHERE src <> dst GROUP BY src, dst
), ways AS (
  SELECT 'trust' AS kind, src AS host, dst AS target, n / sum(n) OVER (PARTITION BY src) AS share FROM links
  UNION ALL
  SELECT 'distrust', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links
), terms AS (
  SELECT 0 AS step, 'trust' AS kind, host, trust::DOUBLE AS value FROM hosts WHERE host <> '' AND trust > 0
  UNION ALL
  SELECT 0, 'distrust', host, distrust::DOUBLE FROM hosts WHERE host <> '' AND distrust > 0
  UNION ALL
  SELECT step + 1, ways.kind, target, {linkgraph.DAMPING} * sum(value * share)
  FROM terms JOIN ways ON ways.kind = terms.kind AND ways.host = terms.host
  WHERE step < {linkgraph.ROUNDS} GROUP BY step, ways.kind, target
), scores AS (
  SELECT host, n_pages,
         CASE WHEN host <> '' THEN coalesce((SELECT sum(value) FROM terms t WHERE t.host = h.host AND kind = 'trust'), 0) END AS trust,
         CASE WHEN host <> '' THEN coalesce((SELECT sum(value) FROM terms t WHERE t.host = h.host AND kind = 'distrust'), 0) END AS distrust
  FROM hosts h
)
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN distrust > trust AND distrust > {linkgraph.MAX_DISTRUST} * n_pages THEN 'block' ELSE 'allow' END) AS verdict,
       round(trust, 6) AS trust, round(distrust, 6) AS distrust
FROM ruled JOIN scores USING (host)
"""

OP12_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
  FROM labels GROUP BY doc_id
), masks AS (
  SELECT texts.doc_id, part, (len(w) < {audit.MIN_WORDS})::INT
    + 2 * (100 * len(list_distinct(w)) < {audit.MIN_DISTINCT_PERCENT} * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {audit.MAX_UPPER_PERCENT} * length(t))::INT
    + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t), false)::INT AS mask
  FROM texts
), counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM masks LEFT JOIN said USING (doc_id) GROUP BY part, mask
), letter AS (SELECT unnest(string_split('ABCDE', '')) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
         coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::INT AS earlier
  FROM orders, (SELECT unnest(range(1, 6))::INT AS step)
)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (own | earlier) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & own <> 0), 0)::BIGINT AS shapley
FROM counted, steps GROUP BY part, filter_order, step
"""


def op13_sql() -> str:
    distance = "list_sum(list_transform(list_zip(s, b), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    size = orchard.ENTRIES
    parts = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({orchard.SCALE} * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {orchard.PARTS}) + 1 : (p + 1) * (len(v) // {orchard.PARTS})] AS s
  FROM kept, (SELECT unnest(range({orchard.PARTS})) AS p)
), book0 AS MATERIALIZED (
  SELECT p, dense_rank() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, s AS b FROM cut
  WHERE vec_id IN (SELECT vec_id FROM (SELECT DISTINCT vec_id FROM kept ORDER BY vec_id LIMIT {size}))
)"""
    for at in range(orchard.ROUNDS + 1):
        parts += f""", near{at} AS MATERIALIZED (
  SELECT vec_id, label, cut.p, s, min({distance} * {size} + e) AS best
  FROM cut JOIN book{at} book ON cut.p = book.p GROUP BY vec_id, label, cut.p, s
)"""
        if at < orchard.ROUNDS:
            parts += f""", sums{at} AS (
  SELECT p, best % {size} AS e, place, sum(s[place])::BIGINT AS total, count(*) AS n
  FROM near{at}, (SELECT unnest(range(1, 1 + (SELECT max(len(s)) FROM cut))) AS place) GROUP BY p, e, place
), book{at + 1} AS MATERIALIZED (
  SELECT book.p, book.e, coalesce(means.b, book.b) AS b FROM book{at} book LEFT JOIN (
    SELECT p, e, list((total - ((total % n) + n) % n) // n ORDER BY place) AS b FROM sums{at} GROUP BY p, e
  ) means ON means.p = book.p AND means.e = book.e
)"""
    last = orchard.ROUNDS
    return f"""{parts}, coded AS (
  SELECT vec_id, label, string_agg(lower(printf('%02x', best % {size})), '' ORDER BY p) AS code,
         sum(best // {size})::BIGINT AS error FROM near{last} GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(b, ','), ',' ORDER BY p, e)) FROM book{last}) AS codebooks_sha256
FROM coded
"""


ORACLE_SQL: dict[str, str] = {
    "op1_suffix_quality": OP1_SQL,
    "op11_host_trust": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
    "op13_orchard_codes": op13_sql(),
}

"""Registered queries of the numbered operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from portolan.llm import (
    bpe, infill, licences, lines, mixing, packing, probminhash, quality, subtrees, suffixes, toxicity, vectors, whitening,
)
from portolan.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.near_lines(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_exact(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_documents(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.digest(bpe.decode(encoded, ranks))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.dedup_bytes(table(spark, sf_dir, "documents")))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subtrees.digest(subtrees.dedup_substrings(table(spark, sf_dir, "documents")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(infill.fill_in_middle(table(spark, sf_dir, "documents")))


def op12_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op13_whiten_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(whitening.whiten(table(spark, sf_dir, "embeddings")))


SPACES = "'[\\x20\\x09-\\x0D]+'"

OP8_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT r, list_filter(string_split_regex(text, {SPACES}), lambda x: x <> '') AS w FROM docs),
grams AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i,
         unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g
  FROM split WHERE len(w) >= 3),
repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (
    SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c > 1)
  GROUP BY r),
lines AS (
  SELECT r, source, text, line, trim(regexp_replace(lower(line), {SPACES}, ' ', 'g')) AS norm
  FROM (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_replace(line, {SPACES}, '', 'g') <> ''),
dups AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT source, count(DISTINCT text) AS n FROM docs GROUP BY source),
bad AS (
  SELECT l.source, norm FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, norm, h.n HAVING count(DISTINCT text) > {quality.MAX_DOCS} AND count(DISTINCT text) > {quality.MAX_SHARE} * h.n),
lost AS (
  SELECT r, sum(len(string_split(l.norm, ' '))) AS n
  FROM lines l JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND l.norm = b.norm GROUP BY r),
facts AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, {SPACES}, '', 'g')) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost_words
  FROM docs JOIN split USING (r) LEFT JOIN repeats USING (r) LEFT JOIN dups USING (r) LEFT JOIN lost USING (r)),
judged AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM facts)
SELECT * EXCLUDE (n_lost_words), NOT base_failed AND NOT (n_lost_words > 0 AND n_words - n_lost_words < {quality.MIN_LEFT}) AS kept, n_lost_words
FROM judged
"""

OP10_SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), {SPACES}), lambda x: x <> '') AS w FROM documents),
windows AS (
  SELECT r, doc_id, unnest(range(1, len(w) - {subtrees.LENGTH - 2})) AS i,
         unnest(list_transform(range(1, len(w) - {subtrees.LENGTH - 2}), lambda i: md5(list_aggregate(w[i : i + {subtrees.LENGTH - 1}], 'string_agg', ' ')))) AS g
  FROM split WHERE len(w) >= {subtrees.LENGTH}),
covered AS (
  SELECT DISTINCT r, unnest(range(i, i + {subtrees.LENGTH})) AS p
  FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS low FROM windows) WHERE low < doc_id),
gone AS (SELECT r, list(p) AS ps, count(*) AS n FROM covered GROUP BY r),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM split),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""


MARKED = " OR ".join(f"contains(text, '{m}')" for m in infill.Markers())

OP11_SQL = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{infill.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u,
         list_transform(range(0, 4), lambda i: CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT)) AS d
  FROM docs),
cut AS (
  SELECT doc_id, text, u, len(u) AS n, least(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS a, greatest(d[1] % (len(u) + 1), d[2] % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR {MARKED} OR d[3] % 100 >= {infill.RATE} THEN 'plain'
              WHEN d[4] % 100 < {infill.SPM_SHARE} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 :], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def queries() -> dict[str, Query]:
    """Name to callable (spark, sf_dir) -> DataFrame."""
    found = (
        op1_toxicity, op2_line_dedup, op3_embedding_near_dedup, op4_mix_sources, op5_license_scan, op6_minhash_near_dedup,
        op7_byte_bpe, op8_quality_rules, op9_suffix_array_dedup, op10_substring_dedup, op11_fill_in_middle, op12_pack_sequences,
        op13_whiten_embeddings,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express over whole tables."""
    return {"op8_quality_rules": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op11_fill_in_middle": OP11_SQL}

"""Queries over the tables of a folder, one for each operator, and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, filter_audit, license_scan, line_dedup, lm_ppm, packing, quality, simhash, substring_dedup, token_binary, toxicity, vector_codes


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_docs(spark, sf_dir))


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, folder = token_binary.write_tokens(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_binary.read_tokens(files, folder)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir), keep="largest")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(_docs(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=1024)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.bpe_round_trip(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select("doc_id", "n_tokens", digest("ids_text").alias("ids_sha256"), digest("decoded").alias("decoded_sha256"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ppm.ppm_scores(_docs(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_docs(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "fallback_share", "token_entropy", "script")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_token_binary, op3_exact_dedup, op4_line_dedup, op5_packing, op6_bpe, op7_lm_scoring, op8_toxicity, op9_simhash, op10_quality_rules, op11_vector_codes, op12_filter_audit, op13_license_scan)}

def _codes_sql(rounds: int) -> str:
    """Rounds of nearest entries and floored means, one after the other; whole numbers below 2**53 are exact as doubles."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS MATERIALIZED (
  SELECT vec_id, part, entry, sum((q - c) * (q - c))::BIGINT AS dist FROM comp JOIN c{i} USING (part, pos) GROUP BY ALL),
a{i} AS MATERIALIZED (
  SELECT vec_id, part, min(dist * 16 + entry) % 16 AS entry, min(dist * 16 + entry) // 16 AS dist FROM d{i} GROUP BY ALL)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT o.part, o.entry, o.pos, coalesce(n.c, o.c) AS c FROM c{i} o LEFT JOIN (
    SELECT part, entry, pos, floor(sum(q)::DOUBLE / count(*))::BIGINT AS c FROM comp JOIN a{i} USING (vec_id, part) GROUP BY ALL) n
  ON o.part = n.part AND o.entry = n.entry AND o.pos = n.pos)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, embedding, len(embedding) // 8 AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (
  SELECT vec_id, width, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM kept),
comp AS MATERIALIZED (
  SELECT vec_id, i // width AS part, i % width AS pos, floor(4096 * x::DOUBLE)::BIGINT AS q FROM flat),
start AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 16),
c0 AS MATERIALIZED (
  SELECT part, entry, pos, q AS c FROM comp JOIN start USING (vec_id)),{",".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


ORACLES: dict[str, str] = {
    "op3_exact_dedup": """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""",
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keys AS (
  SELECT doc_id, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
seen AS (SELECT key, min(doc_id) AS first FROM keys WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keys.*, seen.first IS NOT NULL AND keys.doc_id <> seen.first AS gone FROM keys LEFT JOIN seen ON keys.key = seen.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op11_vector_codes": _codes_sql(vector_codes.ROUNDS),
    "op12_filter_audit": r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
f AS (
  SELECT doc_id, part, [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text), regexp_matches(text, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY doc_id),
g AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(bad, false) AS bad, count(*) AS n FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a),
orders AS (
  SELECT v.a || w.a || x.a || y.a || z.a AS filter_order FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.a, w.a, x.a, y.a, z.a])) = 5),
placed AS (
  SELECT part, filter_order, fails, good, bad, n, list_filter([1, 2, 3, 4, 5], lambda k: fails[ascii(filter_order[k]) - 64]) AS failed FROM g, orders),
steps AS (
  SELECT part, filter_order, step, fails, good, bad, n, failed, fails[ascii(filter_order[step]) - 64] AS own, coalesce(failed[1], 6) AS gone
  FROM placed, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counts AS (
  SELECT part, filter_order, step::INTEGER AS step, coalesce(sum(n) FILTER (gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND gone < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND len(failed) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(n) FILTER (gone = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (gone = step AND bad), 0)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM counts""",
}

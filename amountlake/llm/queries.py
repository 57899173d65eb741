"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, kn_quality, langid, mixing, simhash, substring_dedup, suffix_dedup, tokenbin
from .common import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = materialize(chat.transcripts(_table(spark, sf_dir, "conversations")), "transcripts")
    return chat.digest(chat.format_transcripts(raw, chat.fit(raw), ["conv_id", "part", "roles"]))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenbin.tokenize(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rotated_codes": op1_rotated_codes,
    "op2_source_mix": op2_source_mix,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_token_files": op8_token_files,
    "op9_kneser_ney": op9_kneser_ney,
    "op10_simhash": op10_simhash,
}

_OP2_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce((length(text) + 1) / (length(text) + 1 + 20 * (length(text) - length(translate(text, '%&*$#!@^~|<>{}=', '')))), 1.0)::DOUBLE AS quality,
         (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null' || md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
keyed AS (SELECT *, -ln(u) / quality AS key FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 3.0::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER o, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0)) AS level,
         row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth
  FROM ranked WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT arg_min(level, nth) FILTER (WHERE cap > level * weight) AS lowest FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN l.cap > l.level * l.weight THEN (SELECT lowest FROM chosen) * l.weight ELSE l.cap END AS target FROM levels l),
plans AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 0 END AS epochs FROM targets),
pass0 AS (
  SELECT k.doc_id, k.source, k.key, k.size, p.source_size, p.target, p.epochs, greatest(0, p.target - p.epochs * p.source_size) AS rest, 0 AS more, k.size > 0 AS open
  FROM keyed k JOIN plans p ON k.source IS NOT DISTINCT FROM p.source)""" + "".join(
    f"""
, upto{i} AS (
  SELECT *, (sum(more * size) OVER (PARTITION BY source)) + sum(CASE WHEN open THEN size ELSE 0 END) OVER w AS upto
  FROM pass{i - 1} WINDOW w AS (PARTITION BY source ORDER BY key, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
fits{i} AS (SELECT *, open AND upto - {'size / 2.0' if i == 3 else '0'} <= rest AS fits FROM upto{i}),
over{i} AS (
  SELECT *, sum(CASE WHEN open AND NOT fits THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY key, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS nth FROM fits{i}),
pass{i} AS (
  SELECT doc_id, source, key, size, source_size, target, epochs, rest, CASE WHEN fits THEN 1 ELSE more END AS more, open AND NOT fits AND nth > 1 AS open FROM over{i})"""
    for i in (1, 2, 3)
) + """
SELECT doc_id, size, source_size, target, (size * (epochs + more))::BIGINT AS taken FROM pass3
"""

_OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
places AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
marked AS (
  SELECT doc_id, i, ws[i] AS word,
         CASE WHEN i + 19 <= len(ws) AND row_number() OVER (PARTITION BY CASE WHEN i + 19 <= len(ws) THEN md5(array_to_string(ws[i:i+19], ' ')) END ORDER BY doc_id, i) > 1 THEN i END AS late
  FROM places),
gone AS (
  SELECT doc_id, i, word, max(late) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS removed
  FROM marked),
sums AS (
  SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(s.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
FROM words w LEFT JOIN sums s ON w.doc_id = s.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op2_source_mix": _OP2_SQL, "op3_substring_dedup": _OP3_SQL}

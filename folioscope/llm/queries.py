"""The queries of the operators over the driver's tables, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, jaccard, langid, licenses, media, mixing, pii, quality, urlfilter
from .common import prepare, table

#: The rules of op4's contract, as (verdict, host, path).
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "example.net", "/de/8"), ("allow", "net", "/de/"), ("block", "org", "/es/")]


def pii_key(spark: SparkSession) -> bytes:
    """The key of the pseudonyms, from the secret in the setting folioscope.pii.secret; a demonstration key where it is unset."""
    return hashlib.sha256(spark.conf.get("folioscope.pii.secret", "demonstration").encode()).digest()


def _remainder(n: int) -> Column:
    """crc32 of the id as text; null ids have none."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score. A null doc_id is neither held out nor learned from."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_remainder(4) != 2))
    held = F.coalesce(_remainder(4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, and first_slot, the slot of the schedule at which the document enters the mixture."""
    return mixing.mix_documents(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it contains: doc_id, item_id, edits, item_chars, end_char."""
    return decontam.find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.HARD).alias("text"))
    return chat.digest(chat.format_chat(turns.unionByName(hard)))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_points, copy_id over the pictures drawn from all embeddings."""
    prepare(spark)
    pictures = media.render_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return media.copies(pictures.select("vec_id", "image"), id_col="vec_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, and the kinds and places of the replaced values."""
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark)).select("doc_id", "text", F.size("pii").alias("n_replaced"), "pii")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted. A null doc_id is neither held out nor learned from."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"), usable=_remainder(5) != 0)
    held = F.coalesce(_remainder(5) == 0, F.lit(False)).alias("held_out")
    return quality.score(docs.select("doc_id", held, "text"), model).select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_language_id, op2_mixing, op3_jaccard_join, op4_url_filter, op5_decontamination, op6_chat_format, op7_license_scan, op8_media_copies, op9_pii, op10_quality)}


def _rank_sql(edges: str, verdict: str, name: str, rounds: int = 8) -> str:
    """CTEs of the propagation, round by round."""
    out = f"""
{name}_o AS MATERIALIZED (SELECT src, sum(weight) AS o FROM {edges} GROUP BY src), {name}_s AS MATERIALIZED (SELECT src, dst, weight / o AS p FROM {edges} JOIN {name}_o USING (src)),
{name}_r AS MATERIALIZED (SELECT host, count(*)::DOUBLE / (sum(count(*)) OVER ()) AS mass FROM found WHERE host <> '' AND verdict = '{verdict}' GROUP BY host),
{name}_0 AS MATERIALIZED (SELECT host, mass AS score FROM {name}_r)"""
    for k in range(rounds):
        out += f""",
{name}_{k + 1} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT dst AS host, 0.85::DOUBLE * p * score AS score FROM {name}_s JOIN {name}_{k} ON src = host
  UNION ALL SELECT host, 0.15::DOUBLE * mass FROM {name}_r) GROUP BY host)"""
    return out


def _judge_sql() -> str:
    whens = " ".join(
        f"WHEN (host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h}{p}', 'verdict': '{v}'}}" for v, h, p in sorted(URL_RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    )
    host = lambda c: f"translate(coalesce(regexp_extract({c}, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH base AS MATERIALIZED (SELECT page_id, html, {host("url")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
hit AS (SELECT *, CASE {whens} END AS h FROM base),
found AS MATERIALIZED (SELECT page_id, host, path, h.rule AS rule, h.verdict AS verdict FROM hit),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?is)href\s*=\s*["'']?([a-z][a-z0-9+.-]*://[^"''\s>]*)', 1)) AS t FROM base),
names AS (SELECT DISTINCT string_split(host, '.') AS l FROM base), up AS (SELECT DISTINCT array_to_string(l[k:], '.') AS c, array_to_string(l[k+1:], '.') AS p FROM names, range(1, 40) r(k) WHERE k <= len(l) - 2),
e AS (SELECT src, {host("t")} AS dst FROM links UNION ALL SELECT c, p FROM up UNION ALL SELECT p, c FROM up),
edges AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS weight FROM e WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
back AS MATERIALIZED (SELECT dst AS src, src AS dst, weight FROM edges),{_rank_sql("edges", "allow", "t")},{_rank_sql("back", "block", "d")}
SELECT page_id, found.host, path, rule, coalesce(verdict, CASE WHEN round(coalesce(d_8.score, 0) - coalesce(t_8.score, 0), 9) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM found LEFT JOIN t_8 ON t_8.host = found.host LEFT JOIN d_8 ON d_8.host = found.host
"""


SQL = {
    "op2_mixing": mixing.MIX_SQL.format(docs="documents"),
    "op3_jaccard_join": jaccard.LINK_SQL.format(docs="documents"),
    "op4_url_filter": _judge_sql(),
    "op6_chat_format": chat.DIGEST_SQL.format(table="conversations"),
    "op7_license_scan": licenses.scan_sql("documents"),
}

"""Queries whose last step is a fold or a resampling.

The folds are held against recursive SQL, one step a row; resampling and ROUGE-L against plain Python in tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.operators import evaluation, packing

from . import stages
from .expansion import TEXTS, ROLES

_CANDIDATES = f"""SELECT e.query_id, e.chunk_id, e.score, f.chunk_id IS NOT NULL AS in_base, LONG[floor(SIZE[WORDS[c.text]] * REAL[1.3])] AS tokens
  FROM ({TEXTS["expanded_final_score"]}) e JOIN {{chunks}} c ON c.chunk_id = e.chunk_id LEFT JOIN {{fused}} f ON f.query_id = e.query_id AND f.chunk_id = e.chunk_id"""
_DIFFS = "SELECT x.anls - y.anls AS diff FROM {judged} x JOIN {judged} y ON x.id = y.id AND x.sys = 'a' AND y.sys = 'b'"
_SECTIONED = "SELECT doc_id, page, ord, text, block_type, max(CASE WHEN block_type IN ('Title', 'Header') THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord) AS section FROM {blocks}"

# What a page gives by its role; heads and tails are the first and last two paragraphs
_ROLE_PAGES = f"""SELECT r.query_id, r.chunk_id, c.doc_id, c.page, c.text, r.role FROM (SELECT query_id, chunk_id, role FROM ({ROLES}) o UNION ALL SELECT query_id, chunk_id, 'expanded' FROM {{outside}} WHERE sim >= 0.05) r JOIN {{chunks}} c ON c.chunk_id = r.chunk_id"""
_SCORED = f"""SELECT *, count(nth) OVER w AS n, max(score) OVER w AS best FROM (SELECT r.query_id, r.chunk_id, r.role, p.nth, coalesce(p.text, r.text) AS text, coalesce(p.block_type, 'Page') AS block_type,
    CASE WHEN p.nth IS NULL OR SIZE[q.terms] = 0 THEN REAL[0] ELSE REAL[COMMON[DISTINCT_OF[q.terms]; TOKENS[p.text]]] / SIZE[DISTINCT_OF[q.terms]] END AS score
  FROM ({_ROLE_PAGES}) r JOIN {{queries}} q ON q.query_id = r.query_id LEFT JOIN {{paras}} p ON p.doc_id = r.doc_id AND p.page = r.page) s WINDOW w AS (PARTITION BY query_id, chunk_id)"""
_PARTS = f"""SELECT *, CASE WHEN nth IS NULL THEN 'full' WHEN role = 'seed' THEN CASE WHEN score > 0 THEN 'core' WHEN nth >= n - 2 THEN 'tail' END
    WHEN role = 'adjacent' THEN CASE WHEN nth < 2 THEN 'head' WHEN nth >= n - 2 THEN 'tail' WHEN score > 0 THEN 'core' END
    WHEN score > 0 OR best = 0 AND nth < 2 THEN 'core' END AS part FROM ({_SCORED}) s"""
_SNIPPETS = f"""SELECT query_id, chunk_id, LONG[row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY turn, score DESC, nth)] AS pos, role || '-' || part AS tag, block_type, text, score FROM
    (SELECT query_id, chunk_id, role, nth, text, block_type, part, CASE WHEN part = 'core' THEN round(score, 6) ELSE REAL[0] END AS score,
       CASE part WHEN 'head' THEN 0 WHEN 'tail' THEN 1 WHEN 'core' THEN CASE role WHEN 'adjacent' THEN 2 ELSE 0 END ELSE 0 END AS turn FROM ({_PARTS}) p WHERE part IS NOT NULL
     UNION ALL SELECT query_id, chunk_id, role, nth, text, block_type, 'core', REAL[0], 2 FROM ({_PARTS}) p WHERE role = 'seed' AND best = 0 AND nth IS NOT NULL) x"""


def role_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs that a page gives by its role: of seeds those that share words with the question and the last two, all if none does."""
    return stages.frame(spark, sf_dir, _SNIPPETS, {"paras": paragraph_merge(spark, sf_dir)})


def conditional_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.conditional_pack(stages.frame(spark, sf_dir, _CANDIDATES))


def base_first_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.conditional_pack(stages.frame(spark, sf_dir, _CANDIDATES), margin=None)


def paragraph_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.merge_paragraphs(stages.frame(spark, sf_dir, _SECTIONED))


def rouge_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.frame(spark, sf_dir, "SELECT id, sys, gold_n, pred_n FROM {judged}").select("id", "sys", evaluation.rouge_l("gold_n", "pred_n").alias("rouge_l"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap_ci(stages.frame(spark, sf_dir, _DIFFS))


def approximate_randomization(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.approximate_randomization(stages.frame(spark, sf_dir, _DIFFS))


QUERIES = {f.__name__: f for f in (conditional_pack, base_first_pack, paragraph_merge, role_snippets, rouge_l, bootstrap_ci, approximate_randomization)}

#: The packing rule, offer by offer: phase 1 is the first 2k base pages, phase 2 the others, phase 3 the base again.
_PACK_SQL = """
WITH RECURSIVE c AS MATERIALIZED ({candidates}),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id, in_base ORDER BY score DESC, chunk_id) AS r FROM c),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY phase, r) AS step FROM
  (SELECT *, 1 AS phase FROM b WHERE in_base AND r <= 40 UNION ALL SELECT *, 2 FROM b WHERE NOT in_base UNION ALL SELECT *, 3 FROM b WHERE in_base) x),
w AS (SELECT query_id, 0 AS step, 0::BIGINT AS used, 0 AS extra, []::VARCHAR[] AS ids FROM (SELECT DISTINCT query_id FROM c) q
  UNION ALL SELECT query_id, step, CASE WHEN ok THEN used + tokens ELSE used END, CASE WHEN ok AND phase = 2 THEN extra + 1 ELSE extra END, CASE WHEN ok THEN list_append(ids, chunk_id) ELSE ids END FROM
    (SELECT w.query_id, o.step, w.used, w.extra, w.ids, o.tokens, o.phase, o.chunk_id, o.tokens > 0 AND w.used + o.tokens <= 4500 AND len(w.ids) < 20 AND NOT list_contains(w.ids, o.chunk_id) AND
       CASE o.phase WHEN 1 THEN w.used < 3150 WHEN 2 THEN w.extra < 2 AND {near} ELSE w.used < 4500 END AS ok
     FROM w JOIN o ON o.query_id = w.query_id AND o.step = w.step + 1) y),
l AS (SELECT query_id, max_by(ids, step) AS ids FROM w GROUP BY query_id)
SELECT query_id, unnest(ids) AS chunk_id, unnest(range(1, len(ids) + 1))::BIGINT AS pos FROM l
"""
_NEAR = "o.score >= coalesce((SELECT max(b.score) FROM b WHERE b.query_id = w.query_id AND b.in_base AND NOT list_contains(w.ids, b.chunk_id)), -1e9) - 0.03::DOUBLE"
#: Paragraphs block by block, with the section and the words so far.
_PARAGRAPH_SQL = """
WITH RECURSIVE b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY ord) AS r, len(string_split(text, ' ')) AS words FROM
  (SELECT doc_id, page, ord, trim(text) AS own, text AS raw, regexp_replace(trim(text), '\\s+', ' ', 'g') AS text, block_type, section FROM ({blocks}) x WHERE trim(text) <> '') y),
w AS (SELECT doc_id, page, 0::BIGINT AS r, NULL::BIGINT AS section, 0::BIGINT AS words, -1::BIGINT AS nth, true AS ended FROM (SELECT DISTINCT doc_id, page FROM b) p
  UNION ALL SELECT doc_id, page, r, section, words, nth, floor(words * 1.3::DOUBLE) >= 40 FROM (SELECT doc_id, page, r, CASE WHEN cut THEN own ELSE section END AS section, CASE WHEN cut OR ended THEN here ELSE words + here END AS words, CASE WHEN cut OR ended THEN nth + 1 ELSE nth END AS nth FROM
    (SELECT w.doc_id, w.page, b.r, w.section, w.words, w.nth, w.ended, b.words AS here, b.section AS own, b.block_type IN ('Header', 'Title') OR (b.section IS NOT NULL AND b.section IS DISTINCT FROM w.section) AS cut
     FROM w JOIN b ON b.doc_id = w.doc_id AND b.page = w.page AND b.r = w.r + 1) z) v),
k AS (SELECT w.doc_id, w.page, w.nth, w.section, b.ord, b.raw, b.block_type, count(*) OVER t AS votes, min(b.ord) OVER t AS first FROM w JOIN b ON b.doc_id = w.doc_id AND b.page = w.page AND b.r = w.r
  WINDOW t AS (PARTITION BY w.doc_id, w.page, w.nth, b.block_type))
SELECT doc_id, page, nth, string_agg(raw, chr(10) ORDER BY ord) AS text, first(block_type ORDER BY votes DESC, first) AS block_type, first(section) AS section, count(*) AS n FROM k GROUP BY doc_id, page, nth
"""

SQL = {
    "conditional_pack": _PACK_SQL.format(candidates=stages.oracle(_CANDIDATES), near=_NEAR),
    "base_first_pack": _PACK_SQL.format(candidates=stages.oracle(_CANDIDATES), near="true"),
    "paragraph_merge": _PARAGRAPH_SQL.format(blocks=stages.oracle(_SECTIONED)),
    "role_snippets": stages.oracle(_SNIPPETS.replace("{paras}", "(" + _PARAGRAPH_SQL.format(blocks=stages.oracle(_SECTIONED)) + ")")),
}

"""Named queries over the driver's tables and the SQL they are held against."""

from __future__ import annotations

from . import expansion, folds, parsing, stages

#: Predicate aliases, alias then canonical name.
PREDICATES = {"1_urgent": "urgent", "2_high": "high", "3_medium": "medium", "4_not_specified": "unspecified", "5_low": "low"}
_ALIAS = " ".join(f"WHEN '{a}' THEN '{c}'" for a, c in PREDICATES.items())

_SECTION_EXPAND = "SELECT query_id, chunk_id, max(score) AS score FROM (SELECT r.query_id, c.chunk_id, round(0.7 * r.score, 6) AS score FROM {ranked} r JOIN {chunks} c ON c.doc_id = r.doc_id AND c.section = r.section WHERE r.pos <= 10 AND NOT EXISTS (SELECT 1 FROM {fused} f WHERE f.query_id = r.query_id AND f.chunk_id = c.chunk_id)) x GROUP BY query_id, chunk_id"

TEXTS: dict[str, str | tuple[str, str]] = {
    "text_normalize": "SELECT doc_id, ord, trim(RR[RR[lower(text); '[^a-z0-9]+'; ' ']; ' +'; ' ']) AS norm FROM {blocks}",
    "mention_normalize": "SELECT id, trim(RR[RR[RR[lower(trim(a)); '^(the|a|an) '; '']; ' *[(].*?[)] *'; ' ']; ' +'; ' ']) AS mention FROM {predictions}",
    "unit_normalize": "SELECT item_id, trim(replace(replace(replace(replace('12,345 percent of 3 million dollars ' || TEXT[item_id], ',', ''), ' percent', '%'), ' million', 'M'), 'M dollars', '$M')) AS answer FROM {benchmark}",
    "token_estimate": "SELECT chunk_id, LONG[floor(SIZE[WORDS[text]] * REAL[1.3])] AS tokens, SIZE[WORDS[text]] * REAL[1.3] AS exact, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END AS cut FROM {chunks}",
    "think_strip": "SELECT item_id, CASE WHEN contains(t, '</think>') THEN trim(substr(t, instr(t, '</think>') + 8)) WHEN contains(t, '<think>') THEN '' ELSE trim(t) END AS answer FROM (SELECT item_id, CASE item_id % 3 WHEN 0 THEN '<think>plan</think> ' || substr(text, 1, 20) WHEN 1 THEN '<think>open ' || substr(text, 1, 20) ELSE substr(text, 1, 20) END AS t FROM {benchmark}) x",
    "block_typing": "SELECT doc_id, ord, page, block_type, role FROM {blocks}",
    "page_chunks": "SELECT chunk_id, doc_id, page, text, section FROM {chunks}",
    "doc_card": "SELECT doc_id, substr(ORDERED[text; ord; ' | '], 1, 512) AS card FROM (SELECT doc_id, text, min(ord) AS ord FROM {blocks} WHERE block_type IN ('Title', 'Header') GROUP BY doc_id, text) h GROUP BY doc_id",
    "heading_depth": "SELECT doc_id, ord, CASE WHEN block_type = 'Title' THEN 0 ELSE least(dense_rank() OVER (PARTITION BY doc_id, block_type ORDER BY length(text) % 7 DESC) - 1, 4) + 1 END AS depth FROM {blocks} WHERE block_type IN ('Title', 'Header')",
    "governing_header": "SELECT doc_id, ord, max(CASE WHEN block_type IN ('Title', 'Header') THEN ord END) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS header FROM {blocks}",
    "corpus_semi_join": ("SELECT chunk_id FROM {gold_chunks}", "SELECT c.chunk_id FROM {chunks} c WHERE EXISTS (SELECT 1 FROM {gold_docs} g WHERE g.doc_id = c.doc_id)"),
    "caption_band_join": "SELECT f.doc_id, f.ord, min(c.ord) AS caption FROM {blocks} f JOIN {blocks} c ON f.doc_id = c.doc_id AND f.page = c.page AND c.block_type = 'Caption' AND abs((c.ord % 3) * 30 - (f.ord % 3) * 30) < 50 WHERE f.block_type = 'Paragraph' GROUP BY f.doc_id, f.ord",
    "eligible_blocks": "SELECT doc_id, ord FROM (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM {blocks} WHERE block_type IN ('Paragraph', 'Caption', 'Header') AND length(text) >= 20) e WHERE n <= 50",
    "bm25_term_stats": "SELECT term, df, round(idf, 6) AS idf FROM {term_stats}",
    "bm25_topk": "SELECT query_id, chunk_id, score, pos FROM {bm25} WHERE pos <= 10",
    "dense_topk": "SELECT query_id, chunk_id, score, pos FROM {dense} WHERE pos <= 10",
    "dense_rescore": stages.by_vector("SELECT b.query_id, b.chunk_id, DOT[q.v; p.v] AS sim FROM {bm25} b JOIN {qvec} q ON q.query_id = b.query_id JOIN {pvec} p ON p.chunk_id = b.chunk_id", "b.chunk_id"),
    "hybrid_topk": "SELECT query_id, chunk_id, score, pos FROM {ranked} WHERE pos <= 10",
    "three_channel_fusion": expansion.PAGE_FUSION,
    "minmax_seed_gate": "SELECT query_id, chunk_id, w FROM {seeds}",
    "local_bonus": "SELECT query_id, chunk_id, round(bonus, 6) AS bonus FROM {local}",
    "final_score": "SELECT b.query_id, b.chunk_id, round(b.base + coalesce(l.bonus, 0), 6) AS score FROM {base} b LEFT JOIN {local} l ON l.query_id = b.query_id AND l.chunk_id = b.chunk_id",
    "roles": expansion.ROLES,
    "flat_pack": "SELECT query_id, chunk_id, pos FROM (SELECT query_id, chunk_id, pos, sum(SIZE[WORDS[text]] * REAL[1.3]) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {ranked} WHERE pos <= 10) p WHERE used <= 4500",
    "page_only_pack": "SELECT query_id, chunk_id, pos FROM (SELECT query_id, chunk_id, pos, sum(SIZE[WORDS[text]] * REAL[1.3]) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {ranked}) p WHERE used <= 4500",
    "section_expand": (_SECTION_EXPAND.replace("{chunks}", "{fused_chunks}"), _SECTION_EXPAND),
    "gold_page_match": "SELECT query_id, chunk_id FROM {gold_pages}",
    "retrieval_metrics": """SELECT k, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM (SELECT q.query_id, k.k, max(CASE WHEN r.pos <= k.k AND g.chunk_id IS NOT NULL THEN REAL[1] ELSE REAL[0] END) AS hit,
        coalesce(sum(CASE WHEN r.pos <= k.k AND g.chunk_id IS NOT NULL THEN REAL[1] ELSE REAL[0] END) / nullif(max(n.n), 0), 0) AS recall, coalesce(max(CASE WHEN r.pos <= k.k AND g.chunk_id IS NOT NULL THEN REAL[1] / r.pos END), 0) AS rr
        FROM {queries} q CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 3 UNION ALL SELECT 5 UNION ALL SELECT 10) k LEFT JOIN {ranked} r ON r.query_id = q.query_id LEFT JOIN {gold_pages} g ON g.query_id = r.query_id AND g.chunk_id = r.chunk_id
        LEFT JOIN (SELECT query_id, count(*) AS n FROM {gold_pages} GROUP BY query_id) n ON n.query_id = q.query_id GROUP BY q.query_id, k.k) m GROUP BY k""",
    "rank_diagnosis": "SELECT g.query_id, min(b.pos) AS bm25_rank, min(d.pos) AS dense_rank, min(r.pos) AS fused_rank FROM {gold_pages} g LEFT JOIN {bm25} b ON b.query_id = g.query_id AND b.chunk_id = g.chunk_id LEFT JOIN {dense} d ON d.query_id = g.query_id AND d.chunk_id = g.chunk_id LEFT JOIN {ranked} r ON r.query_id = g.query_id AND r.chunk_id = g.chunk_id GROUP BY g.query_id",
    "page_cap_sweep": "SELECT cap, count(*) AS pages, round(REAL[sum(SIZE[WORDS[text]])] / count(*), 3) AS words, count(g.chunk_id) AS gold FROM {ranked} r JOIN (SELECT 1 AS cap UNION ALL SELECT 2 UNION ALL SELECT 4 UNION ALL SELECT 8) c ON r.pos <= c.cap LEFT JOIN {gold_pages} g ON g.query_id = r.query_id AND g.chunk_id = r.chunk_id GROUP BY cap",
    "predicate_canonical": f"SELECT id, predicate, CASE predicate {_ALIAS} ELSE predicate END AS canonical FROM {{assertions}}",
    "kg_edges": "SELECT src, dst, kind FROM {edges}",
    "grounded_page_counts": ("""SELECT CASE kind WHEN 0 THEN 'c' || TEXT[key] WHEN 1 THEN 'p' || TEXT[key] END AS entity, doc_id, page, n FROM (SELECT kind, key, doc_id, page, count(*) AS n FROM (SELECT CASE WHEN key IS NULL THEN 2 ELSE kind END AS kind, key, doc_id, page FROM
        (SELECT inline(array(struct(0 AS kind, a.cust AS key, s.doc_id, s.page), struct(1 AS kind, a.part AS key, s.doc_id, s.page))) FROM {facts} a JOIN {order_lines} s ON s.id = a.id) x DISTRIBUTE BY kind, key) y GROUP BY kind, key, doc_id, page) z""", "SELECT entity, doc_id, page, count(*) AS n FROM (SELECT a.subject AS entity, s.doc_id, s.page FROM {assertions} a JOIN {supports} s ON s.id = a.id UNION ALL SELECT a.object, s.doc_id, s.page FROM {assertions} a JOIN {supports} s ON s.id = a.id) x GROUP BY entity, doc_id, page"),
    "kg_neighborhood": ("""SELECT DISTINCT node FROM (SELECT 'c1' AS node UNION ALL SELECT inline(array(struct('a' || TEXT[id] AS node), struct('s' || TEXT[doc_id] || '_' || TEXT[page] AS node))) FROM {near_lines} UNION ALL SELECT 'p' || TEXT[min(part)] FROM {near_lines} GROUP BY id
        UNION ALL SELECT /*+ BROADCAST(n) */ 'c' || TEXT[o_custkey] FROM {orders} JOIN (SELECT DISTINCT id FROM {near_lines}) n ON n.id = o_orderkey) n""", "SELECT DISTINCT node FROM (SELECT 'c1' AS node UNION ALL SELECT y FROM {near} UNION ALL SELECT b.y FROM {both_ways} b JOIN {near} o ON b.x = o.y) n"),
    "assertion_context": "SELECT a.id, a.subject, a.predicate, a.object, ORDERED[s.support; s.support; ','] AS supports FROM {assertions} a JOIN {supports} s ON s.id = a.id GROUP BY a.id, a.subject, a.predicate, a.object",
    "same_as_pairs": "SELECT x.vec_id AS a, y.vec_id AS b, DOT[x.embedding; y.embedding] AS sim FROM {embeddings} x JOIN {embeddings} y ON x.vec_id < y.vec_id AND x.vec_id % 2 = y.vec_id % 2 WHERE DOT[x.embedding; y.embedding] >= 0.35",
    "qa_metrics": "SELECT sys, count(*) AS n, round(avg(em), 6) AS em, round(avg(anls), 6) AS anls FROM {judged} GROUP BY sys",
    "breakdown": "SELECT sys, hops, kind, count(*) AS n, round(avg(em), 6) AS em FROM {judged} GROUP BY GROUPING SETS ((sys, hops), (sys, kind), (sys))",
    "hop_buckets": "SELECT sys, bucket, count(*) AS n, round(avg(em), 6) AS em FROM {judged} j JOIN (SELECT 2 AS lo, 2 AS hi, '2' AS bucket UNION ALL SELECT 3, 3, '3' UNION ALL SELECT 4, 99, '4+' UNION ALL SELECT 2, 99, '2+' UNION ALL SELECT 0, 99, 'all') b ON j.hops BETWEEN b.lo AND b.hi GROUP BY sys, bucket",
    "win_tie_loss": "SELECT LONG[sum(CASE WHEN x.anls > y.anls THEN 1 ELSE 0 END)] AS win, LONG[sum(CASE WHEN x.anls = y.anls THEN 1 ELSE 0 END)] AS tie, LONG[sum(CASE WHEN x.anls < y.anls THEN 1 ELSE 0 END)] AS loss, round(avg(x.em - y.em), 6) AS delta FROM {judged} x JOIN {judged} y ON x.id = y.id AND x.sys = 'a' AND y.sys = 'b'",
    "flip_buckets": "SELECT x.em AS em_a, y.em AS em_b, count(*) AS n FROM {judged} x JOIN {judged} y ON x.id = y.id AND x.sys = 'a' AND y.sys = 'b' GROUP BY x.em, y.em",
    "factorial_effects": "SELECT round(avg(CASE WHEN sys = 'a' THEN em END) - avg(CASE WHEN sys = 'b' THEN em END), 6) AS main_sys, round(avg(CASE WHEN hops >= 3 THEN em END) - avg(CASE WHEN hops < 3 THEN em END), 6) AS main_hops FROM {judged}",
    "agent_novelty": """SELECT conv_id, turn, SIZE[now] AS n_tokens, COMMON[now; prev] AS common, CASE WHEN SIZE[now] = 0 OR SIZE[prev] = 0 THEN 0.0 ELSE round(REAL[COMMON[now; prev]] / EITHER[now; prev], 6) END AS jaccard FROM
        (SELECT conv_id, turn, now, lag(now) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM (SELECT conv_id, turn, DISTINCT_OF[TOKENS[text]] AS now FROM {conversations} WHERE role = 'user') t) u WHERE prev IS NOT NULL""",
    "checkpoint_resume": "SELECT d.doc_id FROM {documents} d WHERE NOT EXISTS (SELECT 1 FROM {documents} p WHERE p.doc_id % 3 = 0 AND p.doc_id = d.doc_id)",
    "label_rollup": "SELECT quality, toxic, count(*) AS n FROM {labels} GROUP BY ROLLUP (quality, toxic)",
    "visual_query_class": "SELECT query_id, CASE WHEN contains(question, 'color') OR contains(question, 'image') OR MATCHES[question; '(^| )(logo|photo|chart|map) '] THEN 'visual' ELSE 'text' END AS kind, CASE WHEN MATCHES[question; '(^| )(as of|during|since|until) '] THEN 'temporal' WHEN MATCHES[question; '(^| )(list|all of|how many|each) '] THEN 'list' ELSE 'plain' END AS route FROM {queries}",
    "evidence_page_ids": "SELECT doc_id, page, PAGE_ID[doc_id; page] AS chunk_id, PAGE_ID[doc_id; page + 1] AS next_id FROM {chunks}",
    "snippet_coverage": "SELECT r.query_id, r.chunk_id, round(REAL[COMMON[DISTINCT_OF[q.terms]; TOKENS[r.text]]] / SIZE[DISTINCT_OF[q.terms]], 6) AS coverage FROM {ranked} r JOIN {queries} q ON q.query_id = r.query_id WHERE SIZE[q.terms] > 0",
}

TEXTS |= expansion.TEXTS | parsing.TEXTS

QUERIES = {name: stages.query(sql) for name, sql in TEXTS.items()} | folds.QUERIES
SQL = {name: stages.oracle(sql) for name, sql in TEXTS.items()} | folds.SQL

"""Queries of hierarchy, entity expansion, packing and diagnostics."""

from __future__ import annotations

#: Sweep of the gate's least similarity.
GATES = (0.0, 0.05, 0.1, 0.2, 0.35)
_GATES = " UNION ALL ".join(f"SELECT REAL[{g}] AS tau" for g in GATES)
_TYPES = "CASE id % 6 WHEN 0 THEN 'TextQ' WHEN 1 THEN 'TableQ' WHEN 2 THEN 'ImageQ' WHEN 3 THEN 'Compose(TextQ,TableQ)' WHEN 4 THEN 'Compare(TextQ,ImageQ)' ELSE 'Intersect(TableQ,TextQ)' END"
_NORM = "trim(RR[RR[lower({0}); '[^a-z0-9]+'; ' ']; ' +'; ' '])"
ROLES = """SELECT b.query_id, b.chunk_id, CASE WHEN max(CASE WHEN s.chunk_id = b.chunk_id THEN 1 ELSE 0 END) = 1 THEN 'seed' WHEN max(CASE WHEN abs(s.page - b.page) = 1 THEN 1 ELSE 0 END) = 1 THEN 'adjacent' ELSE 'other' END AS role
      FROM {base} b LEFT JOIN {seeds} s ON s.query_id = b.query_id AND s.doc_id = b.doc_id GROUP BY b.query_id, b.chunk_id"""
PAGE_FUSION = """SELECT query_id, chunk_id, round((0.4 * t / nullif(mt, 0) + 0.35 * v / nullif(mv, 0)) / 0.75, 6) AS score FROM (SELECT *, max(t) OVER (PARTITION BY query_id) AS mt, max(v) OVER (PARTITION BY query_id) AS mv FROM
        (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.chunk_id, y.chunk_id) AS chunk_id, coalesce(x.score, 0) AS t, coalesce(y.score, 0) AS v FROM {bm25} x FULL OUTER JOIN {dense} y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id) u) w"""

_ORACLE_CONTEXT = "SELECT query_id, ORDERED[text; chunk_id; chr(10) || chr(10)] AS context FROM (SELECT g.query_id, c.chunk_id, c.text, sum(SIZE[WORDS[c.text]] * REAL[1.3]) OVER (PARTITION BY g.query_id ORDER BY c.chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM {gold_pages} g JOIN {chunks} c ON c.chunk_id = g.chunk_id) x WHERE used <= 4500 GROUP BY query_id"

TEXTS: dict[str, str | tuple[str, str]] = {
    "answer_normalize": "SELECT id, sys, pred_n FROM {judged}",
    "answer_normalize_plain": "SELECT id, NO_ARTICLES[lower(a)] AS norm FROM {predictions}",
    "ocr_clean": r"SELECT doc_id, RR[RR[RR[RR[lower(text); PAT['[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]']; '']; PAT['[ \t]+']; ' ']; PAT['\n\n\n+']; chr(10) || chr(10)]; PAT['^[ \n]+|[ \n]+$']; ''] AS clean FROM {documents}",
    "entity_type": "SELECT p_partkey, CASE WHEN MATCHES[v; '^[0-9.,]+$'] THEN 'Value' WHEN MATCHES[v; '^[A-Z][^ ]*( [A-Z][^ ]*)+$'] THEN 'Entity' ELSE 'Thing' END AS kind, MATCHES[v; '[0-9]'] AND length(v) < 50 AS literal FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN TEXT[p_partkey] ELSE 'Acme Part ' || TEXT[p_partkey] END AS v FROM {part}) x",
    "question_attributes": f"SELECT id, LONG[COUNT_OF[t; '[A-Za-z]+Q']] AS hops, CASE WHEN HAS[t; 'ImageQ'] AND HAS[t; 'TextQ'] THEN 'cross' WHEN HAS[t; 'TableQ'] AND HAS[t; 'TextQ'] THEN 'text+table' WHEN HAS[t; 'ImageQ'] THEN 'image' WHEN HAS[t; 'TableQ'] THEN 'table' ELSE 'text' END AS modality, CASE WHEN HAS[t; '('] THEN substr(t, 1, instr(t, '(') - 1) ELSE 'Single' END AS type_group FROM (SELECT id, {_TYPES} AS t FROM {{predictions}}) x",
    "answer_in_text": f"SELECT r.query_id, r.chunk_id, HAS[r.text; p.gold] AS verbatim, HAS[{_NORM.format('r.text')}; {_NORM.format('p.gold')}] AS normalised, round(REAL[COMMON[DISTINCT_OF[TOKENS[p.gold]]; TOKENS[r.text]]] / SIZE[DISTINCT_OF[TOKENS[p.gold]]], 6) AS overlap FROM {{ranked}} r JOIN {{predictions}} p ON p.id = r.query_id WHERE SIZE[TOKENS[p.gold]] > 0",
    "fuzzy_match": "SELECT id, sys, HAS[gold_n; pred_n] OR REAL[COMMON[DISTINCT_OF[TOKENS[pred_n]]; TOKENS[gold_n]]] >= 0.5 * greatest(SIZE[DISTINCT_OF[TOKENS[pred_n]]], 1) AS hit FROM {judged}",
    "number_extract": r"SELECT doc_id, LONG[SIZE[n]] AS n, JOINED[n; '|'] AS numbers FROM (SELECT doc_id, FOUND[text; PAT['[0-9]+[.]?[0-9]*']] AS n FROM {documents}) x",
    "prompt_hash": "SELECT query_id, SHA['Question: ' || question] AS digest FROM {queries}",
    "bbox_scale": "SELECT doc_id, ord, round(x0 * sx, 6) AS x0, round(y0 * sy, 6) AS y0, round(x1 * sx, 6) AS x1, round(y1 * sy, 6) AS y1 FROM (SELECT doc_id, ord, REAL[0] AS x0, REAL[ord] AS y0, REAL[length(text)] AS x1, REAL[ord] + length(text) % 7 + 10 AS y1, REAL[1000] / 612 AS sx, REAL[1400] / 792 AS sy FROM {blocks}) b",
    "heading_parent": "SELECT doc_id, ord, LONG[depth] AS depth, parent FROM {parents}",
    "content_parent": "SELECT b.doc_id, b.ord, max(h.ord) AS parent FROM {blocks} b LEFT JOIN {headings} h ON h.doc_id = b.doc_id AND h.ord < b.ord WHERE b.block_type NOT IN ('Title', 'Header') GROUP BY b.doc_id, b.ord",
    "section_path": """SELECT a.doc_id, a.ord, coalesce(e.text || ' > ', '') || coalesce(d.text || ' > ', '') || coalesce(c.text || ' > ', '') || coalesce(b.text || ' > ', '') || a.text AS path FROM {parents} a LEFT JOIN {parents} b ON b.doc_id = a.doc_id AND b.ord = a.parent
      LEFT JOIN {parents} c ON c.doc_id = b.doc_id AND c.ord = b.parent LEFT JOIN {parents} d ON d.doc_id = c.doc_id AND d.ord = c.parent LEFT JOIN {parents} e ON e.doc_id = d.doc_id AND e.ord = d.parent""",
    "alias_match": "SELECT query_id, entity, alias, n FROM {matched}",
    "alias_expand": "SELECT query_id, chunk_id, votes FROM {alias_pages}",
    "expansion_gate": "SELECT query_id, chunk_id, sim FROM {outside} WHERE sim >= 0.05",
    "expanded_scale": "SELECT query_id, chunk_id, round(0.45 * sim, 6) AS scaled, round(CASE WHEN hi - lo < 1e-8 THEN CASE WHEN 0.6 * sim >= hi THEN 1 ELSE 0 END ELSE greatest(least((0.6 * sim - lo) / (hi - lo), 1), 0) END, 6) AS comparable FROM {outside}",
    "expanded_final_score": """SELECT query_id, chunk_id, max(score) AS score FROM (SELECT b.query_id, b.chunk_id, round(b.base + coalesce(l.bonus, 0) + CASE WHEN a.votes IS NULL THEN 0 ELSE 0.12 END, 6) AS score FROM {base} b LEFT JOIN {local} l ON l.query_id = b.query_id AND l.chunk_id = b.chunk_id
        LEFT JOIN {alias_pages} a ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id UNION ALL SELECT query_id, chunk_id, round(0.45 * sim + 0.12, 6) FROM {outside} WHERE sim >= 0.05) x GROUP BY query_id, chunk_id""",
    "gate_sweep": f"SELECT t.tau, count(o.chunk_id) AS pages, count(g.chunk_id) AS gold FROM ({_GATES}) t LEFT JOIN {{outside}} o ON o.sim >= t.tau LEFT JOIN {{gold_pages}} g ON g.query_id = o.query_id AND g.chunk_id = o.chunk_id GROUP BY t.tau",
    "maxsim_two_stage": "SELECT query_id, chunk_id, score, LONG[pos] AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM {maxsim}) r WHERE pos <= 40",
    "type_aware_seed": """SELECT query_id, chunk_id, round(CASE WHEN page % 3 = 0 THEN 0.6 * d + 0.4 * (0.5 * bn + 0.5 * d) ELSE 0.4 * bn + 0.6 * d END, 6) AS score FROM (SELECT x.query_id, x.chunk_id, c.page, x.d, CASE WHEN x.top > 0 THEN x.b / x.top ELSE 0 END AS bn FROM
        (SELECT *, max(b) OVER (PARTITION BY query_id) AS top FROM (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.chunk_id, y.chunk_id) AS chunk_id, coalesce(x.score, 0) AS b, coalesce(y.score, 0) AS d FROM {bm25} x FULL OUTER JOIN {dense} y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id) u) x
        JOIN {chunks} c ON c.chunk_id = x.chunk_id) z""",
    "precomputed_scores": "SELECT b.query_id, b.chunk_id, b.score FROM {queries} q JOIN {bm25} b ON b.query_id = q.query_id WHERE b.pos <= 5",
    "entity_substring_expand": """SELECT query_id, chunk_id, max(score) AS score FROM (SELECT m.query_id, g.chunk_id, REAL[0.3] AS score FROM {matched} m JOIN {grounded} g ON g.entity = m.entity
        UNION ALL SELECT m.query_id, o.chunk_id, REAL[0.2] FROM {matched} m JOIN {page_entities} e ON e.entity = m.entity JOIN {page_entities} n ON n.chunk_id = e.chunk_id AND n.entity <> e.entity JOIN {grounded} o ON o.entity = n.entity) x GROUP BY query_id, chunk_id""",
    "cooccurrence_edges": "SELECT x.entity AS a, y.entity AS b, count(*) AS weight FROM {page_entities} x JOIN {page_entities} y ON y.chunk_id = x.chunk_id AND x.entity < y.entity GROUP BY x.entity, y.entity",
    "mention_collect": ("SELECT 'c' || TEXT[cust] AS mention FROM (SELECT DISTINCT o_custkey AS cust FROM {orders} LEFT SEMI JOIN {lineitem} ON l_orderkey = o_orderkey) a UNION ALL SELECT 'p' || TEXT[part] FROM (SELECT DISTINCT part FROM {facts} WHERE part IS NOT NULL) b", "SELECT DISTINCT mention FROM (SELECT subject AS mention FROM {assertions} UNION ALL SELECT object FROM {assertions} WHERE NOT (MATCHES[object; '^[0-9]'] AND length(object) < 50)) m"),
    "mention_write_back": "SELECT a.id, coalesce(e.canonical, a.subject) AS subject, a.object FROM {assertions} a LEFT JOIN (SELECT 'c' || TEXT[c_custkey] AS alias, 'n' || TEXT[c_nationkey] AS canonical FROM {customer}) e ON e.alias = a.subject",
    "same_as_edges": "SELECT a, b FROM (SELECT x.vec_id AS a, y.vec_id AS b FROM {embeddings} x JOIN {embeddings} y ON x.vec_id < y.vec_id AND x.vec_id % 2 = y.vec_id % 2 WHERE DOT[x.embedding; y.embedding] >= 0.35 UNION ALL SELECT y.vec_id, x.vec_id FROM {embeddings} x JOIN {embeddings} y ON x.vec_id < y.vec_id AND x.vec_id % 2 = y.vec_id % 2 WHERE DOT[x.embedding; y.embedding] >= 0.35) e",
    # a support with a line of a text claim is kept, and only such lines are asked for
    "visual_filter": ("SELECT 's' || TEXT[s.doc_id] || '_' || TEXT[s.page] AS support, s.id FROM {order_lines} s JOIN {facts} a ON a.id = s.id WHERE s.id % 3 <> 0", "SELECT s.support, s.id FROM {supports} s JOIN (SELECT support, max(CASE WHEN modality = 'text' THEN 1 ELSE 0 END) AS kept FROM {supports} x JOIN {claims} c ON c.id = x.id GROUP BY support) k ON k.support = s.support JOIN {claims} c ON c.id = s.id WHERE k.kept = 1 AND c.modality = 'text'"),
    "qc_filter": """SELECT id, round(confidence * CASE WHEN modality = 'text' THEN 1 WHEN source IS NULL THEN 0.8 WHEN hit THEN 1 ELSE 0.6 END, 6) AS confidence FROM (SELECT c.id, c.modality, c.confidence, t.source, HAS[t.source; c.object] OR HAS[t.source; c.predicate] OR c.id % 2 = 0 AS hit FROM {claims} c LEFT JOIN {claim_text} t ON t.id = c.id WHERE c.grounded) x
      WHERE modality = 'text' OR source IS NULL OR hit""",
    "grounding_coverage": """SELECT query_id, round(avg(hit), 6) AS support_coverage FROM (SELECT p.id AS query_id, max(CASE WHEN REAL[COMMON[DISTINCT_OF[TOKENS[p.gold]]; TOKENS[r.text]]] >= 0.5 * SIZE[DISTINCT_OF[TOKENS[p.gold]]] THEN REAL[1] ELSE REAL[0] END) AS hit FROM {predictions} p JOIN {ranked} r ON r.query_id = p.id WHERE r.pos <= 10 GROUP BY p.id) x GROUP BY query_id""",
    "system_deltas": "SELECT kind, round(avg(CASE WHEN sys = 'a' THEN em END) - avg(CASE WHEN sys = 'b' THEN em END), 6) AS em_delta, round(avg(CASE WHEN sys = 'a' THEN anls END) - avg(CASE WHEN sys = 'b' THEN anls END), 6) AS anls_delta FROM {judged} GROUP BY kind",
    "support_chain_coverage": """SELECT q.query_id, coalesce(max(CASE WHEN r.pos <= 10 THEN 1 ELSE 0 END), 0) AS any_at_10, count(DISTINCT CASE WHEN r.pos <= 20 THEN r.doc_id END) AS found_docs, max(n.n) AS gold_docs FROM {queries} q JOIN (SELECT query_id, count(*) AS n FROM {gold_docs} GROUP BY query_id) n ON n.query_id = q.query_id
      JOIN {gold_docs} g ON g.query_id = q.query_id LEFT JOIN {ranked} r ON r.query_id = g.query_id AND r.doc_id = g.doc_id GROUP BY q.query_id""",
    "retrieval_diversity": "SELECT query_id, count(*) AS docs, round(REAL[max(n)] / sum(n), 6) AS largest_share FROM (SELECT query_id, doc_id, count(*) AS n FROM {ranked} WHERE pos <= 10 GROUP BY query_id, doc_id) d GROUP BY query_id",
    "oracle_sets": """SELECT cond, query_id, count(*) AS pages FROM (SELECT 'final' AS cond, query_id, chunk_id FROM {ranked} WHERE pos <= 10 UNION SELECT 'gold', query_id, chunk_id FROM {gold_pages} UNION SELECT 'gold_adjacent', query_id, PAGE_ID[doc_id; page + d] FROM {gold_pages} CROSS JOIN (SELECT -1 AS d UNION ALL SELECT 0 UNION ALL SELECT 1) w WHERE page + d >= 0
        UNION SELECT 'gold_prepended', query_id, chunk_id FROM {gold_pages} UNION SELECT 'gold_prepended', query_id, chunk_id FROM {ranked} WHERE pos <= 10) x GROUP BY cond, query_id""",
    "oracle_context": (_ORACLE_CONTEXT.replace("{chunks}", "{gold_chunks}"), _ORACLE_CONTEXT),
    "reorder_priors": "SELECT query_id, chunk_id, LONG[row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)] AS by_base, LONG[row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos <= 10 OR base >= 0.2 THEN 0 ELSE 1 END, score DESC, chunk_id)] AS guarded, LONG[row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN pos <= 3 THEN 0 ELSE 1 END, page, chunk_id)] AS anchored FROM {base}",
    "plan_evidence_union": """SELECT query_id, chunk_id, sub FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY sub, pos) AS n FROM (SELECT query_id, chunk_id, 0 AS sub, pos FROM {bm25} WHERE pos <= 10 UNION ALL SELECT query_id, chunk_id, 1, pos FROM {dense} WHERE pos <= 10) u) r WHERE n = 1""",
    "visual_query_split": "SELECT sys, kind, count(*) AS n, round(avg(em), 6) AS em FROM (SELECT sys, em, CASE WHEN kind IN (2, 4) THEN 'visual' ELSE 'text' END AS kind FROM {judged}) j GROUP BY sys, ROLLUP (kind)",
    "snippet_serialize": "SELECT query_id, ORDERED['[Doc: ' || substr(TEXT[doc_id], 1, 8) || ' | Page: ' || TEXT[page] || ' | Role: ' || CASE WHEN pos <= 3 THEN 'seed' ELSE 'other' END || ']' || chr(10) || text; pos; chr(10) || chr(10)] AS packet FROM {ranked} WHERE pos <= 5 GROUP BY query_id",
    "scope_markers": "SELECT query_id, chunk_id, CASE WHEN prev IS NULL OR prev <> coalesce(section, -1) THEN '[SCOPE] ' || coalesce(TEXT[section], '') ELSE '' END AS scope FROM (SELECT query_id, chunk_id, section, lag(coalesce(section, -1)) OVER (PARTITION BY query_id ORDER BY pos) AS prev FROM {ranked} WHERE pos <= 10) x",
    "evidence_summary": "SELECT query_id, ORDERED['- ' || substr(text, 1, 150); pos; chr(10)] AS summary FROM {ranked} WHERE pos <= 10 GROUP BY query_id",
    "all_at_k": """SELECT k, round(avg(CASE WHEN found >= n THEN REAL[1] ELSE REAL[0] END), 6) AS all_at_k FROM (SELECT q.query_id, k.k, max(coalesce(n.n, 0)) AS n, sum(CASE WHEN r.pos <= k.k AND g.chunk_id IS NOT NULL THEN 1 ELSE 0 END) AS found FROM {queries} q CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 5 UNION ALL SELECT 10) k
        LEFT JOIN {ranked} r ON r.query_id = q.query_id LEFT JOIN {gold_pages} g ON g.query_id = r.query_id AND g.chunk_id = r.chunk_id LEFT JOIN (SELECT query_id, count(*) AS n FROM {gold_pages} GROUP BY query_id) n ON n.query_id = q.query_id GROUP BY q.query_id, k.k) m GROUP BY k""",
    # The fused pages up to the first one over the budget
    "page_fusion_pack": f"""SELECT query_id, chunk_id, pos FROM (SELECT f.query_id, f.chunk_id, f.pos, sum(SIZE[WORDS[c.text]] * REAL[1.3]) OVER (PARTITION BY f.query_id ORDER BY f.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used
      FROM (SELECT query_id, chunk_id, LONG[row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)] AS pos FROM ({PAGE_FUSION}) g) f JOIN {{chunks}} c ON c.chunk_id = f.chunk_id WHERE f.pos <= 20) p WHERE used <= 4500""",
    "ablation_filter": "SELECT modality, grounded, count(*) AS n FROM {claims} GROUP BY modality, grounded",
}

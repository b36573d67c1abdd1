"""Queries of walks over the graph, parsing of model answers, novelty, grounding and looked-up scores."""

from __future__ import annotations

#: Nodes that a walk takes, and the kinds of edges that it follows.
WALK_NODES = 20
WALK_KINDS = "('subject_of', 'object_of', 'supports')"

# answers as a model would give them: prose around a JSON array, some of them cut off
_ITEM = """chr(123) || '"subject": " ' || subject || ' ", "predicate": "' || predicate || '", "object": "' || CASE WHEN supports = 1 THEN '  ' ELSE object END || '"' || CASE WHEN supports = 2 THEN ', "grounded": false' WHEN supports = 3 THEN ', "grounded": true' ELSE '' END || chr(125)"""
_RESPONSES = f"""SELECT subject AS block, 'The triples [as asked]: '  || CASE WHEN n > 12 THEN '[' || items || ', {{{{"subject": ]' ELSE '' END || '[' || items || '] done' AS answer, n
  FROM (SELECT subject, ORDERED[item; id; ', '] AS items, count(*) AS n FROM (SELECT id, subject, {_ITEM} AS item FROM {{assertions}}) i GROUP BY subject) g"""
_ARRAY = f"SELECT block, n, substr(answer, instr(answer, ']:') + 3) AS answer FROM ({_RESPONSES}) r"
_VALID = "trim(subject) <> '' AND trim(predicate) <> '' AND trim(object) <> '' AND coalesce(grounded, true)"
_OUT = "block, LONG[nth] AS nth, trim(subject) AS subject, trim(predicate) AS predicate, trim(object) AS object"

# headings in order; depth d keeps the first d names of the path so far
_SLICED = (
    """SELECT doc_id, z.ord, z.path FROM (SELECT doc_id, explode(aggregate(hs, named_struct('p', cast(array() AS array<string>), 'out', cast(array() AS array<struct<ord: bigint, path: string>>)),
        (s, h) -> named_struct('p', array_append(slice(s.p, 1, h.depth), h.text), 'out', array_append(s.out, named_struct('ord', h.ord, 'path', array_join(array_append(slice(s.p, 1, h.depth), h.text), ' > ')))), s -> s.out)) AS z
      FROM (SELECT doc_id, array_sort(collect_list(struct(ord, cast(depth AS INT) AS depth, text))) AS hs FROM {headings} GROUP BY doc_id) g) x""",
    """SELECT doc_id, ord, array_to_string(p, ' > ') AS path FROM (WITH RECURSIVE r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM {headings}),
        w AS (SELECT doc_id, ord, n, [text] AS p FROM r WHERE n = 1 UNION ALL SELECT r.doc_id, r.ord, r.n, list_append(w.p[1:r.depth], r.text) FROM w JOIN r ON r.doc_id = w.doc_id AND r.n = w.n + 1) SELECT * FROM w) x""",
)

_TURNS = "SELECT conv_id, turn, DISTINCT_OF[UWORDS[text]] AS now FROM {conversations} WHERE role = 'user'"

_STEPS = f"SELECT src AS x, dst AS y, 0 AS way FROM {{edges}} WHERE kind IN {WALK_KINDS} UNION ALL SELECT dst, src, 1 FROM {{edges}} WHERE kind IN {WALK_KINDS}"

STAGES: dict[str, str | tuple[str, str]] = {
    # Places of a walk, level by level; a node keeps the first place that leads to it
    "steps": _STEPS,
    "walk_one": f"""SELECT start, node, pos FROM (SELECT start, node, LONG[1 + row_number() OVER (PARTITION BY start ORDER BY way, node)] AS pos FROM
        (SELECT x AS start, y AS node, min(way) AS way FROM {{steps}} WHERE MATCHES[x; '^c[0-9]+$'] AND y <> x GROUP BY x, y) a) b WHERE pos <= {WALK_NODES}""",
    "walk_two": f"""SELECT start, node, pos FROM (SELECT c.start, c.node, LONG[1 + n.n + row_number() OVER (PARTITION BY c.start ORDER BY c.place, c.node)] AS pos FROM
        (SELECT w.start, s.y AS node, min(2 * w.pos + s.way) AS place FROM {{walk_one}} w JOIN {{steps}} s ON s.x = w.node LEFT JOIN {{walk_one}} o ON o.start = w.start AND o.node = s.y
          WHERE s.y <> w.start AND o.node IS NULL GROUP BY w.start, s.y) c JOIN (SELECT start, count(*) AS n FROM {{walk_one}} GROUP BY start) n ON n.start = c.start) d WHERE pos <= {WALK_NODES}""",
    "walk": "SELECT DISTINCT start, start AS node, LONG[1] AS pos FROM {walk_one} UNION ALL SELECT start, node, pos FROM {walk_one} UNION ALL SELECT start, node, pos FROM {walk_two}",
    # What a question's answer rests on; long answers ask for a section that names their first word
    "atoms": "SELECT id AS query_id, gold AS content, CASE WHEN SIZE[WORDS[gold]] > 5 THEN ELEMENT[WORDS[gold]; 1] END AS scope FROM {predictions} WHERE SIZE[WORDS[gold]] > 4 UNION ALL SELECT id, b, CAST(NULL AS VARCHAR(99)) FROM {predictions} WHERE SIZE[WORDS[gold]] > 4",
    "retrieved_sections": "SELECT r.query_id, r.chunk_id, DISTINCT_OF[WORDS[r.text]] AS words, lower(coalesce(b.text, '')) AS section FROM {ranked} r LEFT JOIN {blocks} b ON b.doc_id = r.doc_id AND b.ord = r.section WHERE r.pos <= 10",
    # The last question with a text names the scores that the text finds
    "last_asked": "SELECT question, max(query_id) AS query_id FROM {queries} GROUP BY question",
}

_WALK_SUPPORTS = "SELECT w.start, s.doc_id, s.page, count(DISTINCT w.node) AS votes FROM {walk} w JOIN (SELECT DISTINCT support, doc_id, page FROM {supports}) s ON s.support = w.node GROUP BY w.start, s.doc_id, s.page"

TEXTS: dict[str, str | tuple[str, str]] = {
    "typed_walk": "SELECT start, node, pos FROM {walk}",
    "walk_supports": (_WALK_SUPPORTS.replace("SELECT DISTINCT support, doc_id, page FROM {supports}", "SELECT 's' || TEXT[doc_id] || '_' || TEXT[page] AS support, doc_id, page FROM {places}"), _WALK_SUPPORTS),
    "json_array": (
        f"SELECT block, LONG[n] AS asked, LONG[coalesce(size(from_json(regexp_extract(answer, '(?s)([\\\\[].*[\\\\]])', 1), 'array<struct<subject: string, predicate: string, object: string, grounded: boolean>>')), 0)] AS parsed FROM ({_ARRAY}) a",
        f"""SELECT block, LONG[n] AS asked, LONG[coalesce(len(from_json(TRY_CAST(regexp_extract(answer, '(?s)(\\[.*\\])', 1) AS JSON), '[{{{{"subject":"VARCHAR","predicate":"VARCHAR","object":"VARCHAR","grounded":"BOOLEAN"}}}}]')), 0)] AS parsed FROM ({_ARRAY}) a""",
    ),
    # the first five of a block, then those that are whole and grounded
    "triples": (
        f"SELECT {_OUT} FROM (SELECT block, nth, t.* FROM (SELECT block, from_json(regexp_extract(answer, '(?s)([\\\\[].*[\\\\]])', 1), 'array<struct<subject: string, predicate: string, object: string, grounded: boolean>>') AS ts FROM ({_ARRAY}) a) p LATERAL VIEW posexplode(ts) AS nth, t) x WHERE nth < 5 AND {_VALID}",
        f"""SELECT {_OUT} FROM (SELECT block, unnest(range(len(ts))) AS nth, unnest(ts, recursive := true) FROM (SELECT block, from_json(TRY_CAST(regexp_extract(answer, '(?s)(\\[.*\\])', 1) AS JSON), '[{{{{"subject":"VARCHAR","predicate":"VARCHAR","object":"VARCHAR","grounded":"BOOLEAN"}}}}]') AS ts FROM ({_ARRAY}) a) p) x WHERE nth < 5 AND {_VALID}""",
    ),
    "section_path_slice": _SLICED,
    # A turn against the one before and against all before; the first has nothing to compare with
    "query_novelty": f"""SELECT conv_id, turn, CASE WHEN SIZE[now] = 0 OR SIZE[past] = 0 THEN REAL[0] ELSE round(REAL[COMMON[now; past]] / EITHER[now; past], 4) END AS jaccard_all, CASE WHEN SIZE[now] = 0 OR SIZE[prev] = 0 THEN REAL[0] ELSE round(REAL[COMMON[now; prev]] / EITHER[now; prev], 4) END AS jaccard_prev,
        CASE WHEN first_turn THEN REAL[1] ELSE round(REAL[SIZE[now] - COMMON[now; past]] / greatest(SIZE[now], 1), 4) END AS new_tokens FROM (SELECT conv_id, turn, now, row_number() OVER w = 1 AS first_turn, coalesce(lag(now) OVER w, NO_STRINGS[now]) AS prev,
          DISTINCT_OF[coalesce(flatten(LISTED[now] OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), NO_STRINGS[now])] AS past FROM ({_TURNS}) t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) u""",
    "grounding_scope": """SELECT q.query_id, round(coalesce(avg(a.aligned), 1), 6) AS support_coverage, round(coalesce(avg(a.scoped), 1), 6) AS scope_coverage FROM {queries} q LEFT JOIN
        (SELECT a.query_id, a.content, a.scope, max(CASE WHEN o.fits THEN REAL[1] ELSE REAL[0] END) AS aligned, max(CASE WHEN o.fits AND (a.scope IS NULL OR HAS[o.section; a.scope]) THEN REAL[1] ELSE REAL[0] END) AS scoped FROM {atoms} a LEFT JOIN
          (SELECT a.query_id, a.content, r.section, REAL[COMMON[DISTINCT_OF[WORDS[a.content]]; r.words]] >= 0.5 * SIZE[DISTINCT_OF[WORDS[a.content]]] AS fits FROM {atoms} a JOIN {retrieved_sections} r ON r.query_id = a.query_id) o
          ON o.query_id = a.query_id AND o.content = a.content GROUP BY a.query_id, a.content, a.scope) a ON a.query_id = q.query_id GROUP BY q.query_id""",
    "score_lookup": "SELECT 'id' AS found_by, q.query_id, b.chunk_id, b.score FROM {queries} q JOIN {bm25} b ON b.query_id = q.query_id WHERE b.pos <= 5 UNION ALL SELECT 'question', q.query_id, b.chunk_id, b.score FROM {queries} q JOIN {last_asked} l ON l.question = q.question JOIN {bm25} b ON b.query_id = l.query_id WHERE b.pos <= 5",
    # A page without a vector scores 0 alone and is left out of many
    "dense_single": "SELECT n.query_id, n.chunk_id, coalesce(DOT[q.v; p.v], REAL[0]) AS sim, p.chunk_id IS NOT NULL AS known FROM (SELECT b.query_id, PAGE_ID[c.doc_id; c.page + 1] AS chunk_id FROM {bm25} b JOIN {chunks} c ON c.chunk_id = b.chunk_id) n JOIN {qvec} q ON q.query_id = n.query_id LEFT JOIN {pvec} p ON p.chunk_id = n.chunk_id",
}

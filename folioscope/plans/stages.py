"""Stage tables of the evidence engine: blocks, page chunks, postings, rankings, graph and predictions.

A stage is SQL over other stages and the source tables, written {name}. In Spark each is a DataFrame that its readers
share; in DuckDB each is a CTE.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.dialect import render
from folioscope.operators.ranking import aliases_of, bm25_best, holders, word_counts
from folioscope.sources.staging import deal, numbered, stage_once

from . import parsing

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Stages whose rows several readers need: written once to the shared checkpoint folder, which also keeps plans short.
#: None holds all texts of the pages, which are read from documents anew, row by row.
KEPT = {"page_ids", "vec", "word_counts", "bm25_all", "bm25", "dense", "fused", "qvec", "gold_docs", "gold_pages", "ranked", "base", "seeds", "alias_df", "page_entities", "alias_pages", "outside", "local", "walk_one"}

_LINES = (
    "SELECT doc_id, lang, cast(pos AS BIGINT) AS ord, trim(col) AS text FROM {documents} LATERAL VIEW posexplode(split(text, '\\n')) AS pos, col",
    "SELECT doc_id, lang, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::BIGINT AS ord, trim(unnest(string_split(text, chr(10)))) AS text FROM {documents}",
)
_TOK = (
    "SELECT chunk_id, col AS term FROM {chunks} LATERAL VIEW explode(TOKENS[text]) AS col",
    "SELECT chunk_id, unnest(TOKENS[text]) AS term FROM {chunks}",
)
_WORD = (
    "SELECT chunk_id, col AS term FROM {chunks} LATERAL VIEW explode(WORDS[text]) AS col",
    "SELECT chunk_id, unnest(WORDS[text]) AS term FROM {chunks}",
)
_QWORD = (
    "SELECT query_id, col AS term FROM {queries} LATERAL VIEW explode(words) AS col",
    "SELECT query_id, unnest(words) AS term FROM {queries}",
)
_QTOK = (
    "SELECT query_id, col AS term FROM {queries} LATERAL VIEW explode(terms) AS col",
    "SELECT query_id, unnest(terms) AS term FROM {queries}",
)

_RANKED = """SELECT f.query_id, f.chunk_id, c.doc_id, c.page, c.text, c.section, f.score, LONG[row_number() OVER (PARTITION BY f.query_id ORDER BY f.score DESC, f.chunk_id)] AS pos
      FROM {fused} f JOIN {chunks} c ON c.chunk_id = f.chunk_id"""
_DENSE = """SELECT query_id, chunk_id, score, LONG[pos] AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM
        (%s) s) r WHERE pos <= 20"""
_GOLD_PAGES = "SELECT DISTINCT g.query_id, c.chunk_id, c.doc_id, c.page FROM {gold_docs} g JOIN {queries} q ON q.query_id = g.query_id JOIN {chunks} c ON c.doc_id = g.doc_id AND contains(lower(c.text), substr(q.question, 1, 20))"


_ALIAS_PAGES = """SELECT query_id, chunk_id, count(*) AS votes FROM (SELECT m.query_id, g.chunk_id, row_number() OVER (PARTITION BY m.query_id, m.entity ORDER BY g.n DESC, g.chunk_id) AS n FROM {matched} m JOIN {grounded} g ON g.entity = m.entity
        JOIN (SELECT DISTINCT query_id, doc_id FROM {seeds}) d ON d.query_id = m.query_id AND d.doc_id = g.doc_id LEFT JOIN {seeds} s ON s.query_id = m.query_id AND s.chunk_id = g.chunk_id WHERE s.chunk_id IS NULL) x WHERE n <= 2 GROUP BY query_id, chunk_id"""

#: G1 by numbers.
_EDGES = """SELECT 'c' || TEXT[cust] AS src, 'a' || TEXT[id] AS dst, 'subject_of' AS kind FROM (SELECT DISTINCT id, cust FROM {facts}) a UNION ALL SELECT 'a' || TEXT[id], 'p' || TEXT[part], 'object_of' FROM (SELECT DISTINCT id, part FROM {facts}) b
    UNION ALL SELECT 'a' || TEXT[id], 's' || TEXT[doc_id] || '_' || TEXT[page], 'supports' FROM {order_lines} c UNION ALL SELECT 's' || TEXT[doc_id] || '_' || TEXT[page], 'prov_s' || TEXT[doc_id] || '_' || TEXT[page], 'grounded_to' FROM {places} d"""


def by_vector(text: str, page: str) -> tuple[str, str]:
    """A query that reads {pvec} p for a column of pages; in Spark vectors are joined to the few pages, not to all."""
    return (re.sub(r"\{pvec\} p ON p\.chunk_id = %s" % re.escape(page), f"{{page_vec}} p ON p.chunk_id = {page} LEFT JOIN {{vec}} pv ON pv.nth = p.vec", text).replace("p.v]", "pv.embedding]"), text)


STAGES: dict[str, str | tuple[str, str]] = {
    "lines": _LINES,
    # Typed blocks; short lines are headings, the first of a document its title
    "blocks": """SELECT doc_id, lang, ord, IDIV[ord; 4] AS page, text, block_type,
        CASE block_type WHEN 'Title' THEN 'scope' WHEN 'Header' THEN 'scope' WHEN 'Caption' THEN 'contextual' WHEN 'Footer' THEN 'exception' ELSE 'primary' END AS role
      FROM (SELECT *, CASE WHEN length(text) <= 40 THEN CASE WHEN row_number() OVER (PARTITION BY doc_id, length(text) <= 40 ORDER BY ord) = 1 THEN 'Title' ELSE 'Header' END
        WHEN ord % 5 = 4 THEN 'Caption' ELSE 'Paragraph' END AS block_type FROM {lines} WHERE text <> '') b""",
    # H5
    "chunks": """SELECT chunk_id, doc_id, page, text, section FROM (SELECT PAGE_ID[doc_id; page] AS chunk_id, doc_id, page, ORDERED[text; ord; chr(10)] AS text,
        min(CASE WHEN block_type IN ('Title', 'Header') THEN ord END) AS section FROM {blocks} GROUP BY doc_id, page) c WHERE length(text) >= 20""",
    "queries": "SELECT item_id AS query_id, lower(text) AS question, TOKENS[text] AS terms, WORDS[text] AS words FROM {benchmark}",
    "tok": _TOK,
    "tf": "SELECT chunk_id, term, count(*) AS tf FROM {tok} GROUP BY chunk_id, term",
    # postings of the ranking are by white space alone
    "word": _WORD,
    "postings": "SELECT chunk_id, term, count(*) AS tf FROM {word} GROUP BY chunk_id, term",
    "qword": _QWORD,
    "lens": "SELECT chunk_id, sum(tf) AS dl FROM {postings} GROUP BY chunk_id",
    "corpus": "SELECT REAL[count(*)] AS n, REAL[sum(dl)] / count(*) AS avgdl FROM {lens}",
    # B1: idf with its floor, a quarter of the mean idf over the vocabulary
    "term_stats": """SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM (SELECT i.*, m.mean FROM {raw_idf} i CROSS JOIN (SELECT avg(idf) AS mean FROM {raw_idf}) m) j""",
    "raw_idf": """SELECT term, df, round(ln(n - df + 0.5) - ln(df + 0.5), 9) AS idf FROM (SELECT term, count(*) AS df FROM {postings} GROUP BY term) d CROSS JOIN {corpus} c""",
    # Spark's way to the idf: how many words have which document frequency; the words of questions and the totals have rows of their own
    "page_words": "SELECT text FROM {chunks}",
    "term_df": "SELECT term, sum(pages) AS df, sum(words) AS words FROM {page_words} GROUP BY term",
    "word_counts": """SELECT d.df, q.term, d.term IS NULL AS total, count(*) AS n, sum(d.words) AS words FROM {term_df} d LEFT JOIN (SELECT DISTINCT term FROM {qword}) q ON q.term = d.term GROUP BY d.df, q.term, d.term IS NULL""",
    "mean_idf": "SELECT sum(w.n * round(ln(c.n - w.df + 0.5) - ln(w.df + 0.5), 9)) / sum(w.n) AS mean FROM {word_counts} w CROSS JOIN {corpus} c WHERE NOT total",
    "asked_idf": "SELECT term, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM (SELECT w.term, round(ln(c.n - w.df + 0.5) - ln(w.df + 0.5), 9) AS idf FROM {word_counts} w CROSS JOIN {corpus} c WHERE w.term IS NOT NULL) i CROSS JOIN {mean_idf} m",
    "qtok": _QTOK,
    # B2, per query token with multiplicity
    "bm25_all": """SELECT q.query_id, t.chunk_id, round(sum(s.idf * t.tf * 2.5 / (t.tf + 1.5 * (0.25 + 0.75 * l.dl / c.avgdl))), 6) AS score
      FROM {qword} q JOIN {postings} t ON q.term = t.term JOIN {term_stats} s ON s.term = t.term JOIN {lens} l ON l.chunk_id = t.chunk_id CROSS JOIN {corpus} c GROUP BY q.query_id, t.chunk_id""",
    # Zero scores fill up in corpus order
    "first_chunks": "SELECT chunk_id FROM {chunks} ORDER BY chunk_id LIMIT 20",
    "bm25": """SELECT query_id, chunk_id, score, LONG[pos] AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS pos FROM
        (SELECT query_id, chunk_id, score FROM {bm25_all} UNION ALL SELECT query_id, chunk_id, REAL[0] AS score FROM {queries} CROSS JOIN {first_chunks}
          WHERE NOT EXISTS (SELECT 1 FROM {bm25_all} a WHERE a.query_id = {queries}.query_id AND a.chunk_id = {first_chunks}.chunk_id)) u) r WHERE pos <= 20""",
    "nvec": "SELECT count(*) AS n FROM {embeddings}",
    "vec": "SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS nth, embedding FROM {embeddings}",
    "page_ids": "SELECT chunk_id, doc_id, page FROM {chunks}",
    "page_vec": "SELECT c.chunk_id, c.doc_id, c.page, c.nth % n.n AS vec FROM {page_ids} c CROSS JOIN {nvec} n",
    "pvec": """SELECT chunk_id, doc_id, page, embedding AS v FROM (SELECT chunk_id, doc_id, page, (row_number() OVER (ORDER BY chunk_id) - 1) % n AS nth FROM {chunks} CROSS JOIN {nvec}) c JOIN {vec} USING (nth)""",
    "qvec": "SELECT item_id AS query_id, embedding AS v FROM {benchmark} JOIN {embeddings} ON vec_id = item_id",
    # in Spark a question meets each vector once, then the pages of the best ones; equal scores stay together
    "near_vec": "SELECT query_id, nth, score FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS best FROM (SELECT q.query_id, v.nth, DOT[q.v; v.embedding] AS score FROM {qvec} q CROSS JOIN {page_vecs} v) s) r WHERE best <= 20",
    "page_vecs": "SELECT v.nth, v.embedding FROM {vec} v JOIN (SELECT count(*) AS n FROM {page_vec}) c ON v.nth < c.n",
    "dense": (_DENSE % "SELECT n.query_id, p.chunk_id, n.score FROM {near_vec} n JOIN {page_vec} p ON p.vec = n.nth", _DENSE % "SELECT q.query_id, p.chunk_id, DOT[q.v; p.v] AS score FROM {qvec} q CROSS JOIN {pvec} p"),
    # FU1
    "fused": """SELECT query_id, chunk_id, round(0.4 * CASE WHEN top > 0 THEN b / top ELSE 0 END + 0.6 * d, 6) AS score FROM (SELECT *, max(b) OVER (PARTITION BY query_id) AS top FROM
        (SELECT coalesce(x.query_id, y.query_id) AS query_id, coalesce(x.chunk_id, y.chunk_id) AS chunk_id, coalesce(x.score, 0) AS b, coalesce(y.score, 0) AS d
         FROM {bm25} x FULL OUTER JOIN {dense} y ON x.query_id = y.query_id AND x.chunk_id = y.chunk_id) u) w""",
    "fused_chunks": "SELECT c.* FROM {chunks} c JOIN {fused} f ON f.chunk_id = c.chunk_id",
    "ranked": (_RANKED.replace("{chunks}", "{fused_chunks}"), _RANKED),
    # V2/V3: min-max, then up to three seeds within 85 % of the best
    "base": """SELECT *, round(CASE WHEN hi - lo < 1e-8 THEN 1 ELSE (score - lo) / (hi - lo) END, 6) AS base, max(score) OVER (PARTITION BY query_id) AS best FROM
        (SELECT *, min(score) OVER (PARTITION BY query_id) AS lo, max(score) OVER (PARTITION BY query_id) AS hi FROM {ranked}) r""",
    "seeds": "SELECT query_id, chunk_id, doc_id, page, section, score, pos, round(score / best, 6) AS w FROM {base} WHERE pos <= 3 AND score >= 0.85 * best",
    # V4
    "local": """SELECT query_id, chunk_id, least(max(bonus), 0.05) AS bonus FROM (
        SELECT b.query_id, b.chunk_id, 0.04 * s.w AS bonus FROM {base} b JOIN {seeds} s ON s.query_id = b.query_id AND s.doc_id = b.doc_id AND (b.page = s.page + 1 OR b.page = s.page - 1)
          LEFT JOIN {seeds} o ON o.query_id = b.query_id AND o.chunk_id = b.chunk_id WHERE o.chunk_id IS NULL
        UNION ALL SELECT b.query_id, b.chunk_id, 0.015 * s.w FROM {base} b JOIN {seeds} s ON s.query_id = b.query_id AND s.doc_id = b.doc_id AND s.section = b.section AND s.chunk_id <> b.chunk_id) x GROUP BY query_id, chunk_id""",
    "gold_docs": "SELECT q.query_id, d.doc_id FROM {queries} q JOIN {documents} d ON contains(lower(d.text), substr(q.question, 1, 60))",
    "gold_chunks": "SELECT c.* FROM {chunks} c JOIN {gold_docs} g ON g.doc_id = c.doc_id",
    "gold_pages": (_GOLD_PAGES.replace("{chunks}", "{gold_chunks}"), _GOLD_PAGES),
    # assertions: one per order, supports are its lines
    "assertions": """SELECT o_orderkey AS id, 'c' || TEXT[o_custkey] AS subject, RR[lower(trim(o_orderpriority)); '[^a-z0-9]+'; '_'] AS predicate, 'p' || TEXT[min(l_partkey)] AS object, count(*) AS supports
      FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority""",
    "supports": "SELECT DISTINCT l_orderkey AS id, 's' || TEXT[l_suppkey] || '_' || TEXT[l_linenumber] AS support, l_suppkey AS doc_id, LONG[l_linenumber] AS page FROM {lineitem}",
    # G1
    "edges": """SELECT src, dst, max(kind) AS kind FROM (SELECT subject AS src, 'a' || TEXT[id] AS dst, 'subject_of' AS kind FROM {assertions}
        UNION ALL SELECT 'a' || TEXT[id], object, 'object_of' FROM {assertions} UNION ALL SELECT 'a' || TEXT[id], support, 'supports' FROM {supports}
        UNION ALL SELECT support, 'prov_' || support, 'grounded_to' FROM {supports}) e GROUP BY src, dst""",
    "both_ways": "SELECT src AS x, dst AS y FROM {edges} UNION SELECT dst, src FROM {edges}",
    "near": "SELECT DISTINCT y FROM {both_ways} WHERE x = 'c1'",
    "predictions": """SELECT item_id AS id, item_id % 5 + 1 AS hops, item_id % 6 AS kind, substr(text, 1, 40) AS gold,
        CASE item_id % 4 WHEN 0 THEN substr(text, 1, 40) WHEN 1 THEN 'The ' || UPPER[substr(text, 1, 40)] WHEN 2 THEN 'x' || substr(text, 2, 39) ELSE 'wrong answer' END AS a,
        CASE (item_id + 1) % 4 WHEN 0 THEN substr(text, 1, 40) WHEN 1 THEN 'The ' || UPPER[substr(text, 1, 40)] WHEN 2 THEN 'x' || substr(text, 2, 39) ELSE 'wrong answer' END AS b FROM {benchmark}""",
    # F2/E1/E2, ASCII punctuation and articles removed
    "judged": """SELECT id, hops, kind, sys, gold_n, pred_n, CASE WHEN gold_n = pred_n THEN 1 ELSE 0 END AS em,
        CASE WHEN greatest(length(gold_n), length(pred_n)) = 0 THEN 1.0 WHEN LEV[gold_n; pred_n] < 0.5 * greatest(length(gold_n), length(pred_n)) THEN round(1 - REAL[LEV[gold_n; pred_n]] / greatest(length(gold_n), length(pred_n)), 6) ELSE 0.0 END AS anls
      FROM (SELECT id, hops, kind, sys, NO_ARTICLES[PLAIN[gold]] AS gold_n, NO_ARTICLES[PLAIN[pred]] AS pred_n
        FROM (SELECT id, hops, kind, gold, 'a' AS sys, a AS pred FROM {predictions} UNION ALL SELECT id, hops, kind, gold, 'b', b FROM {predictions}) u) n""",
    # H1/H2: a heading's parent is the latest earlier heading of a smaller depth
    "headings": "SELECT doc_id, ord, text, CASE WHEN block_type = 'Title' THEN 0 ELSE least(dense_rank() OVER (PARTITION BY doc_id, block_type ORDER BY length(text) % 7 DESC) - 1, 4) + 1 END AS depth FROM {blocks} WHERE block_type IN ('Title', 'Header')",
    "parents": "SELECT h.doc_id, h.ord, h.text, h.depth, max(p.ord) AS parent FROM {headings} h LEFT JOIN {headings} p ON p.doc_id = h.doc_id AND p.ord < h.ord AND p.depth < h.depth GROUP BY h.doc_id, h.ord, h.text, h.depth",
    # V1/V5: entities are named by the first one and two words of a benchmark item
    "aliases": """SELECT entity, alias, lead, parts FROM (SELECT 'e' || TEXT[query_id] AS entity, JOINED[FIRST_N[terms; 2]; ' '] AS alias, JOINED[FIRST_N[terms; 1]; ' '] AS lead, 2 AS parts FROM {queries} WHERE SIZE[terms] > 1
        UNION ALL SELECT 'e' || TEXT[query_id], JOINED[FIRST_N[terms; 1]; ' '], JOINED[FIRST_N[terms; 1]; ' '], 1 FROM {queries} WHERE SIZE[terms] > 0) a WHERE length(alias) >= 3""",
    "chunk_norm": "SELECT chunk_id, doc_id, page, ' ' || JOINED[TOKENS[text]; ' '] || ' ' AS norm FROM {chunks}",
    "query_norm": "SELECT query_id, ' ' || JOINED[terms; ' '] || ' ' AS norm FROM {queries}",
    "alias_hits": "SELECT a.entity, a.alias, a.parts, c.chunk_id, c.doc_id, c.page, t.tf FROM {aliases} a JOIN {tf} t ON t.term = a.lead JOIN {chunk_norm} c ON c.chunk_id = t.chunk_id WHERE HAS[c.norm; ' ' || a.alias || ' ']",
    "seed_chunks": "SELECT c.* FROM {chunks} c JOIN {seeds} s ON s.doc_id = c.doc_id",
    "seed_grounded": "SELECT c.*, a.entity FROM {seed_chunks} c CROSS JOIN {aliases} a",
    "page_aliases": "SELECT c.*, a.alias FROM {chunks} c CROSS JOIN {aliases} a",
    "alias_df": "SELECT alias, count(DISTINCT doc_id) AS df FROM {alias_hits} GROUP BY alias",
    "grounded": "SELECT entity, chunk_id, doc_id, page, max(tf) AS n FROM {alias_hits} GROUP BY entity, chunk_id, doc_id, page",
    "matched": """SELECT query_id, entity, alias, LONG[n] AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY parts DESC, length(alias) DESC, df, entity) AS n FROM
        (SELECT q.query_id, a.entity, a.alias, a.parts, coalesce(f.df, 0) AS df, row_number() OVER (PARTITION BY q.query_id, a.entity ORDER BY a.parts DESC, length(a.alias) DESC) AS own
         FROM (SELECT DISTINCT query_id, term FROM {qtok}) k JOIN {aliases} a ON a.lead = k.term JOIN {query_norm} q ON q.query_id = k.query_id AND HAS[q.norm; ' ' || a.alias || ' '] LEFT JOIN {alias_df} f ON f.alias = a.alias
         WHERE coalesce(f.df, 0) <= 10) x WHERE own = 1) y WHERE n <= 2""",
    # V6
    "alias_pages": (_ALIAS_PAGES.replace("{grounded}", "{seed_grounded}"), _ALIAS_PAGES),
    # V8/V9: pages outside the base pool by their dense score, on the pool's scale
    "outside": by_vector("""SELECT a.query_id, a.chunk_id, a.votes, DOT[q.v; p.v] AS sim, b.lo, b.hi FROM {alias_pages} a JOIN {qvec} q ON q.query_id = a.query_id JOIN {pvec} p ON p.chunk_id = a.chunk_id
        JOIN (SELECT DISTINCT query_id, lo, hi FROM {base}) b ON b.query_id = a.query_id LEFT JOIN {fused} f ON f.query_id = a.query_id AND f.chunk_id = a.chunk_id WHERE f.chunk_id IS NULL""", "a.chunk_id"),
    # Four vectors a page, three a query
    "patches": """SELECT r.chunk_id, p.p, v.embedding AS v FROM (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS nth FROM {chunks}) r CROSS JOIN {nvec} n CROSS JOIN (SELECT 0 AS p UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) p
        JOIN {vec} v ON v.nth = (r.nth + p.p) % n.n""",
    "qpatches": "SELECT b.item_id AS query_id, t.t, v.embedding AS v FROM {benchmark} b CROSS JOIN {nvec} n CROSS JOIN (SELECT 0 AS t UNION ALL SELECT 1 UNION ALL SELECT 2) t JOIN {vec} v ON v.nth = (b.item_id + t.t) % n.n",
    "vec_mean": "SELECT x.nth, VADD[VADD[x.embedding; y.embedding]; VADD[z.embedding; w.embedding]] AS v FROM {page_vecs} x CROSS JOIN {nvec} n JOIN {vec} y ON y.nth = (x.nth + 1) % n.n JOIN {vec} z ON z.nth = (x.nth + 2) % n.n JOIN {vec} w ON w.nth = (x.nth + 3) % n.n",
    "page_mean": "SELECT x.chunk_id, VADD[VADD[x.v; y.v]; VADD[z.v; w.v]] AS v FROM {patches} x JOIN {patches} y ON y.chunk_id = x.chunk_id AND y.p = 1 JOIN {patches} z ON z.chunk_id = x.chunk_id AND z.p = 2 JOIN {patches} w ON w.chunk_id = x.chunk_id AND w.p = 3 WHERE x.p = 0",
    "query_mean": "SELECT x.query_id, VADD[VADD[x.v; y.v]; z.v] AS v FROM {qpatches} x JOIN {qpatches} y ON y.query_id = x.query_id AND y.t = 1 JOIN {qpatches} z ON z.query_id = x.query_id AND z.t = 2 WHERE x.t = 0",
    "pooled": "SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, chunk_id) AS n FROM (SELECT q.query_id, p.chunk_id, DOT[q.v; p.v] AS sim FROM {query_mean} q CROSS JOIN {page_mean} p) s) r WHERE n <= 200",
    "maxsim": """SELECT query_id, chunk_id, round(sum(best), 6) AS score FROM (SELECT c.query_id, c.chunk_id, q.t, max(DOT[q.v; p.v]) AS best FROM {pooled} c JOIN {qpatches} q ON q.query_id = c.query_id JOIN {patches} p ON p.chunk_id = c.chunk_id
        GROUP BY c.query_id, c.chunk_id, q.t) b GROUP BY query_id, chunk_id""",
    # Rare entities of a page, at most twenty
    "page_entities": """SELECT chunk_id, entity FROM (SELECT g.chunk_id, g.entity, row_number() OVER (PARTITION BY g.chunk_id ORDER BY g.entity) AS n FROM {grounded} g JOIN (SELECT entity FROM {grounded} GROUP BY entity HAVING count(*) <= 500) k ON k.entity = g.entity) x WHERE n <= 20""",
    # Every third assertion is visual, every seventh is not grounded
    "facts": "SELECT * FROM {orders} CROSS JOIN {lineitem}",
    "order_lines": "SELECT * FROM {lineitem}",
    "places": "SELECT * FROM {lineitem}",
    "near_lines": "SELECT * FROM {orders} CROSS JOIN {lineitem}",
    "claims": "SELECT id, subject, predicate, object, CASE WHEN id % 3 = 0 THEN 'visual' ELSE 'text' END AS modality, id % 7 <> 0 AS grounded, REAL[0.9] AS confidence FROM {assertions}",
    "claim_text": "SELECT s.id, ORDERED[p.p_name; s.line; ' '] AS source FROM (SELECT l_orderkey AS id, l_linenumber AS line, l_partkey FROM {lineitem}) s JOIN {part} p ON p.p_partkey = s.l_partkey WHERE s.id % 5 <> 0 GROUP BY s.id",
} | parsing.STAGES

_REF = re.compile(r"\{(\w+)\}")


def text_of(name: str, engine: int) -> str:
    body = STAGES[name]
    return body if isinstance(body, str) else body[engine]


def needs(sql: str) -> list[str]:
    return list(dict.fromkeys(_REF.findall(sql.replace("{{", "").replace("}}", ""))))


def sources(name: str) -> list[str]:
    """The tables that a stage is made of, sorted."""
    seen, open_ = set(), [name]
    while open_:
        now = open_.pop()
        if now not in seen:
            seen.add(now)
            open_ += needs(text_of(now, 0)) if now not in TABLES else []
    return sorted(seen & set(TABLES))


def _documents_of(ids: str) -> Callable[[SparkSession, str, dict[str, DataFrame]], DataFrame]:
    """The pages of the documents that a query over stages names by doc_id or by the ids of its pages (column named)."""

    def make(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame]) -> DataFrame:
        named = frame(spark, sf_dir, ids, made)
        docs = made.setdefault("documents", spark.read.parquet(f"{sf_dir}/documents.parquet"))
        docs = docs.join(named, F.coalesce(docs["doc_id"].cast("string"), F.lit("null")) == named["named"], "left_semi")
        return _chunks(spark, sf_dir, {"documents": docs})

    return make


def _one_row_each(spark: SparkSession, sf_dir: str) -> bool:
    """Whether each document is one row, so that its pages need no shuffle."""
    docs = lambda: spark.read.parquet(f"{sf_dir}/documents.parquet").groupBy("doc_id").count().where("count > 1").limit(1)
    return stage_once(docs, "repeated_documents", [f"{sf_dir}/documents.parquet"], lambda df: df.isEmpty(), spark)


def _by_row(name: str, local: str) -> Callable[[SparkSession, str, dict[str, DataFrame]], DataFrame]:
    return lambda spark, sf_dir, made: frame(spark, sf_dir, local if _one_row_each(spark, sf_dir) else text_of(name, 0), made)


_blocks = _by_row("blocks", """SELECT doc_id, lang, b.ord, IDIV[b.ord; 4] AS page, b.text, b.block_type,
    CASE b.block_type WHEN 'Title' THEN 'scope' WHEN 'Header' THEN 'scope' WHEN 'Caption' THEN 'contextual' WHEN 'Footer' THEN 'exception' ELSE 'primary' END AS role
  FROM (SELECT doc_id, lang, explode(transform(bs, b -> struct(b.ord AS ord, b.text AS text, CASE WHEN length(b.text) <= 40 THEN CASE WHEN b.ord = title THEN 'Title' ELSE 'Header' END WHEN b.ord % 5 = 4 THEN 'Caption' ELSE 'Paragraph' END AS block_type))) AS b
    FROM (SELECT *, get(filter(bs, b -> length(b.text) <= 40), 0).ord AS title FROM
      (SELECT doc_id, lang, filter(transform(split(text, '\\n'), (t, i) -> struct(LONG[i] AS ord, trim(t) AS text)), b -> b.text <> '') AS bs FROM {documents}) x) y) z""")
_chunks = _by_row("chunks", """SELECT PAGE_ID[doc_id; p.page] AS chunk_id, doc_id, p.page, p.text, p.section FROM (SELECT doc_id, explode(filter(transform(transform(sequence(0, IDIV[size(ls) - 1; 4]), k -> struct(k, filter(transform(slice(ls, INT[4 * k + 1], 4), (t, i) -> struct(4 * k + i AS ord, trim(t) AS text)), b -> b.text <> '') AS bs)),
    p -> struct(p.k AS page, array_join(transform(p.bs, b -> b.text), '\\n') AS text, get(filter(p.bs, b -> length(b.text) <= 40), 0).ord AS section)), p -> length(p.text) >= 20)) AS p
  FROM (SELECT doc_id, split(text, '\\n') AS ls FROM {documents} WHERE text IS NOT NULL) x) y""".replace("INT[4 * k + 1]", "cast(4 * k + 1 AS INT)"))


def _bm25_all(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame]) -> DataFrame:
    """Each task's best pages of a question with their scores, and those of the first pages that share a word with it."""
    of = lambda sql: frame(spark, sf_dir, sql, made)
    weights = of("SELECT q.query_id, q.term, s.idf * q.n AS w FROM (SELECT query_id, term, count(*) AS n FROM {qword} GROUP BY query_id, term) q JOIN {asked_idf} s ON s.term = q.term").collect()
    length = of("SELECT avgdl FROM {corpus}").first()
    first = [r["chunk_id"] for r in of("SELECT chunk_id FROM {first_chunks}").collect()]
    return bm25_best(of("SELECT chunk_id, text FROM {chunks}"), [tuple(r) for r in weights], length["avgdl"] if length else 1.0, first)


def _aliases(pages: str, name: str) -> Callable[[SparkSession, str, dict[str, DataFrame]], DataFrame]:
    def make(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame]) -> DataFrame:
        owners: dict[str, list[str]] = {}
        for r in frame(spark, sf_dir, f"SELECT DISTINCT alias, {name} AS name FROM {{aliases}}", made).collect():
            owners.setdefault(r["alias"], []).append(r["name"])
        found = aliases_of(frame(spark, sf_dir, f"SELECT chunk_id, doc_id, page, text FROM {{{pages}}}", made), owners)
        return found if name == "alias" else found.withColumnRenamed("name", "entity").select("entity", "chunk_id", "doc_id", "page", "n")

    return make


def _dealt(sql: str) -> Callable[[SparkSession, str, dict[str, DataFrame]], DataFrame]:
    """Rows that meet every question, in more parts than their few bytes would give."""
    return lambda spark, sf_dir, made: frame(spark, sf_dir, sql, made).repartition(max(64, 4 * spark.sparkContext.defaultParallelism))


def _gold_docs(spark: SparkSession, sf_dir: str, made: dict[str, DataFrame]) -> DataFrame:
    asked = frame(spark, sf_dir, "SELECT query_id, substr(question, 1, 60) AS start FROM {queries} WHERE question IS NOT NULL AND query_id IS NOT NULL", made).collect()
    return holders(frame(spark, sf_dir, "SELECT doc_id, text FROM {documents}", made), [tuple(r) for r in asked])


#: How Spark makes a stage where that is not its SQL; the rows are those of the SQL, of bm25_all those that bm25 can take.
MAKERS: dict[str, str | Callable[[SparkSession, str, dict[str, DataFrame]], DataFrame]] = {
    "blocks": _blocks,
    "chunks": _chunks,
    "fused_chunks": _documents_of("SELECT DISTINCT substring_index(chunk_id, '_p', 1) AS named FROM {fused}"),
    "gold_chunks": _documents_of("SELECT DISTINCT TEXT[doc_id] AS named FROM {gold_docs} WHERE doc_id IS NOT NULL"),
    "page_words": lambda spark, sf_dir, made: word_counts(frame(spark, sf_dir, "SELECT text FROM {chunks}", made)),
    "corpus": "SELECT REAL[df] AS n, REAL[words] / df AS avgdl FROM {word_counts} WHERE total AND df > 0",
    "raw_idf": "SELECT term, df, round(ln(n - df + 0.5) - ln(df + 0.5), 9) AS idf FROM {term_df} d CROSS JOIN {corpus} c WHERE term IS NOT NULL",
    "term_stats": "SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * mean ELSE idf END AS idf FROM {raw_idf} i CROSS JOIN {mean_idf} m",
    "first_chunks": "SELECT chunk_id FROM {page_ids} WHERE nth < 20",
    "bm25_all": _bm25_all,
    "seed_chunks": _documents_of("SELECT DISTINCT TEXT[doc_id] AS named FROM {seeds} WHERE doc_id IS NOT NULL"),
    # a page's own words tell its aliases, so no words are shuffled
    "page_aliases": _aliases("chunks", "alias"),
    "alias_hits": "SELECT a.entity, a.alias, a.parts, h.chunk_id, h.doc_id, h.page, h.n AS tf FROM {page_aliases} h JOIN {aliases} a ON a.alias = h.name",
    "alias_df": "SELECT name AS alias, count(*) AS df FROM (SELECT DISTINCT name, doc_id FROM {page_aliases}) d WHERE doc_id IS NOT NULL GROUP BY name",
    "grounded": _aliases("chunks", "entity"),
    "seed_grounded": _aliases("seed_chunks", "entity"),
    "gold_docs": _gold_docs,
    "page_vecs": _dealt("SELECT v.nth, v.embedding FROM {vec} v JOIN (SELECT count(*) AS n FROM {page_vec}) c ON v.nth < c.n"),
    "vec_mean": _dealt(text_of("vec_mean", 0)),
    # the graph by its numbers: rows of different kinds never meet, so each is made distinct by itself, dealt by order without adding up before
    "facts": "SELECT o_orderkey AS id, o_custkey AS cust, min(l_partkey) AS part FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_orderpriority",
    "order_lines": "SELECT DISTINCT id, doc_id, page FROM (SELECT l_orderkey AS id, l_suppkey AS doc_id, LONG[l_linenumber] AS page FROM {lineitem} DISTRIBUTE BY id) l",
    "places": "SELECT DISTINCT l_suppkey AS doc_id, LONG[l_linenumber] AS page FROM {lineitem}",
    "edges": _EDGES,
    # the orders of one customer are few, so they go to the lines
    "near_lines": "SELECT /*+ BROADCAST(o) */ l_orderkey AS id, l_partkey AS part, l_suppkey AS doc_id, LONG[l_linenumber] AS page FROM {lineitem} JOIN (SELECT DISTINCT o_orderkey FROM {orders} WHERE o_custkey = 1) o ON o.o_orderkey = l_orderkey",
    # a customer's steps lead to its orders alone, an order's to its customer, its part and its lines
    "walk_one": f"""SELECT start, node, pos, id, n FROM (SELECT 'c' || TEXT[cust] AS start, 'a' || TEXT[id] AS node, id, LONG[1 + row_number() OVER (PARTITION BY cust ORDER BY 'a' || TEXT[id])] AS pos, least(count(*) OVER (PARTITION BY cust), {parsing.WALK_NODES - 1}) AS n
        FROM (SELECT DISTINCT o_custkey AS cust, o_orderkey AS id FROM {{orders}} LEFT SEMI JOIN {{lineitem}} ON l_orderkey = o_orderkey) o) w WHERE pos <= {parsing.WALK_NODES} AND MATCHES[start; '^c[0-9]+$']""",
    "walk_two": f"""SELECT start, node, pos FROM (SELECT start, node, LONG[1 + n + row_number() OVER (PARTITION BY start ORDER BY place, node)] AS pos FROM
        (SELECT w.start, s.node, min(2 * w.pos + s.way) AS place, max(w.n) AS n FROM (SELECT * FROM {{walk_one}} WHERE n < {parsing.WALK_NODES - 1}) w JOIN (SELECT id, inline(array(struct('p' || TEXT[part] AS node, 0 AS way), struct('c' || TEXT[cust] AS node, 1 AS way))) FROM {{facts}}
          UNION ALL SELECT l_orderkey, 's' || TEXT[l_suppkey] || '_' || TEXT[l_linenumber], 0 FROM {{lineitem}}) s ON s.id = w.id WHERE s.node <> w.start GROUP BY w.start, s.node) c) d WHERE pos <= {parsing.WALK_NODES}""",
    # as in dense, a question meets each run of four vectors once, then the pages of the best ones
    "pooled": """SELECT query_id, chunk_id, vec FROM (SELECT s.query_id, p.chunk_id, p.vec, row_number() OVER (PARTITION BY s.query_id ORDER BY s.sim DESC, p.chunk_id) AS n FROM
        (SELECT query_id, nth, sim FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY sim DESC) AS best FROM (SELECT q.query_id, m.nth, DOT[q.v; m.v] AS sim FROM {query_mean} q CROSS JOIN {vec_mean} m) d) r WHERE best <= 200) s JOIN {page_vec} p ON p.vec = s.nth) x WHERE n <= 200""",
    "maxsim": """SELECT query_id, chunk_id, round(sum(best), 6) AS score FROM (SELECT c.query_id, c.chunk_id, q.t, max(DOT[q.v; v.embedding]) AS best FROM (SELECT c.query_id, c.chunk_id, (c.vec + p.p) % n.n AS nth FROM {pooled} c CROSS JOIN {nvec} n CROSS JOIN (SELECT explode(array(0, 1, 2, 3)) AS p) p) c
        JOIN {vec} v ON v.nth = c.nth JOIN {qpatches} q ON q.query_id = c.query_id GROUP BY c.query_id, c.chunk_id, q.t) b GROUP BY query_id, chunk_id""",
}
#: Stages whose rows are numbered in the order of a column, and the columns they need.
NUMBERED = {"page_ids": ("SELECT chunk_id, doc_id, page FROM {chunks}", "chunk_id"), "vec": ("SELECT vec_id, embedding FROM {embeddings}", "vec_id")}


def make(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame]) -> DataFrame:
    """The DataFrame of a table or stage."""
    if name in TABLES:
        deal(spark, f"{sf_dir}/{name}.parquet")
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    paths = [f"{sf_dir}/{t}.parquet" for t in sources(name)]
    if name in NUMBERED:
        sql, key = NUMBERED[name]
        return stage_once(lambda: frame(spark, sf_dir, sql, made), name, paths, lambda df: numbered(df, key), spark)
    how = MAKERS.get(name, text_of(name, 0))
    build = lambda: how(spark, sf_dir, made) if callable(how) else frame(spark, sf_dir, how, made)
    return stage_once(build, name, paths, spark=spark) if name in KEPT else build()


def frame(spark: SparkSession, sf_dir: str, sql: str | tuple[str, str], made: dict[str, DataFrame] | None = None) -> DataFrame:
    """The DataFrame of a query over stages; stages that several readers share are made once."""
    made = {} if made is None else made
    body = sql if isinstance(sql, str) else sql[0]
    for name in needs(body):
        if name not in made:
            made[name] = make(spark, sf_dir, name, made)
    used = {n: made[n] for n in needs(body)}
    flat = render(body, 0)
    for n in used:
        flat = re.sub(r"\{%s\}(?=\.)" % n, f"`{n}`", flat)
        flat = re.sub(r"\{%s\}(?! +(?:AS )?(?!CROSS|FULL|LEFT|JOIN|WHERE|GROUP|ORDER|LATERAL|USING|ON|UNION|LIMIT)[a-z]\w*\b)" % n, "{%s} AS `%s`" % (n, n), flat)
    return spark.sql(flat, **used)


def oracle(sql: str | tuple[str, str]) -> str:
    """The same query as one DuckDB statement, its stages as CTEs."""
    ctes: dict[str, str] = {}

    def add(body: str) -> str:
        for name in needs(body):
            if name not in TABLES and name not in ctes:
                ctes[name] = ""
                text = add(text_of(name, 1))
                del ctes[name]
                ctes[name] = text
        return _REF.sub(r"\1", render(body, 1).replace("{{", "\x01").replace("}}", "\x02")).replace("\x01", "{").replace("\x02", "}")

    main = add(sql if isinstance(sql, str) else sql[1])
    return ("WITH " + ", ".join(f"{n} AS MATERIALIZED ({t})" for n, t in ctes.items()) + " " if ctes else "") + main


def query(sql: str | tuple[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: frame(spark, sf_dir, sql)

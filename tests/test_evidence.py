"""Stage queries against DuckDB on the smallest tables, and the dialect's rendering."""

import os

import duckdb
import pandas as pd
import pytest

from folioscope.functions.dialect import render
from folioscope.plans import registry, stages

SF = "/root/testdata/sf0.001"
QUICK = ["text_normalize", "unit_normalize", "think_strip", "page_chunks", "doc_card", "bm25_topk", "dense_topk", "hybrid_topk", "kg_edges", "qa_metrics", "breakdown", "agent_novelty", "ocr_clean", "heading_parent", "section_path", "alias_match", "qc_filter", "visual_filter", "number_extract", "visual_query_split", "token_estimate", "answer_normalize", "answer_normalize_plain", "bm25_term_stats", "paragraph_merge", "conditional_pack", "base_first_pack", "typed_walk", "walk_supports", "json_array", "triples", "section_path_slice", "query_novelty", "score_lookup"]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple('null' if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x) for x in r) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", QUICK)
def test_same_rows(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(registry.SQL[name]).df())


def test_render():
    assert render("SIZE[TOKENS[a]]", 1) == "len(list_filter(regexp_split_to_array(lower(a), '[^a-z0-9]+'), lambda t: t <> ''))"
    assert render("RR[x; '[a;]'; ' ']", 0) == "regexp_replace(x, '[a;]', ' ')"


@pytest.mark.parametrize("name", ["bm25", "dense"])
def test_top_k_is_limited_before_the_shuffle(spark, name):
    """In the plan of the ranking itself, which is staged: queries only read what it has written."""
    plan = stages.frame(spark, SF, stages.text_of(name, 0))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_ranking_by_hand(spark, tmp_path):
    """BM25 over three chunks: words are split by white space alone, and every word of a question counts, with multiplicity."""
    import math

    from folioscope.functions.dialect import render

    chunks = {"a": "Cat, cat sat", "b": "dog-house sat sat", "c": "cat"}
    question = "cat cat sat " + " ".join(f"w{i}" for i in range(20)) + " dog-house"
    words = {k: t.lower().split() for k, t in chunks.items()}
    df = {t: sum(t in w for w in words.values()) for w in words.values() for t in w}
    idf = {t: math.log(3 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    length = sum(map(len, words.values())) / 3
    want = {}
    for k, w in words.items():
        score = sum(idf[t] * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / length)) for t in question.split() if t in w)
        want[k] = round(score, 5)
    made = {"chunks": spark.createDataFrame(list(chunks.items()), "chunk_id string, text string")}
    made["queries"] = spark.createDataFrame([(1, question)], "query_id long, text string").selectExpr("query_id", render("WORDS[text] AS words", 0))
    for name in ("word", "postings", "lens", "corpus", "raw_idf", "term_stats", "qword", "bm25_all"):
        made[name] = stages.frame(spark, "", stages.text_of(name, 0), made)
    assert {r["chunk_id"]: round(r["score"], 5) for r in made["bm25_all"].collect()} == want


def test_answers_by_hand(spark):
    from folioscope.functions.dialect import render

    rows = [("The a  Cat's [big] {house}\\ (an) apple!", "cats big house apple"), ("a an the", ""), ("Theatre of the absurd", "theatre of absurd"), ("x|y^z~`_", "xyz")]
    sql = render("SELECT NO_ARTICLES[PLAIN[t]] AS n FROM {rows}", 0)
    made = spark.createDataFrame([(t,) for t, _ in rows], "t string")
    assert [r["n"] for r in spark.sql(sql, rows=made).collect()] == [w for _, w in rows]


def test_capitals_are_one_character_for_one(spark, duck):
    """In both engines; a sharp s has its own capital, and ligatures stay."""
    from folioscope.functions.dialect import render

    words = ["stra\u00dfe", "\u00e9t\u00e9 \ufb01n", "\u1f80\u1fb3\u1fb6 \u01f0 \u0149", "a\U0001f600b", ""]
    want = [w for (w,) in duck.execute("SELECT upper(unnest(?))", [words]).fetchall()]
    made = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in spark.sql(render("SELECT UPPER[w] AS u FROM {made}", 0), made=made).collect()] == want
    assert want[0] == "STRA\u1e9eE"


def test_edits_are_of_bytes(spark, duck):
    from folioscope.functions.dialect import render

    pairs = [("caf\u00e9", "cafe"), ("\u00fc\u00f6", "\u00f6\u00fc"), ("abc", "abd"), ("", "\u20ac")]
    want = [duck.execute("SELECT levenshtein(?, ?)", p).fetchone()[0] for p in pairs]
    made = spark.createDataFrame(pairs, "x string, y string")
    assert [r[0] for r in spark.sql(render("SELECT LEV[x; y] AS n FROM {made}", 0), made=made).collect()] == want
    assert want[0] == 2

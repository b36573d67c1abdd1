"""Scans of texts, numbering of rows and pages made row by row, against plain Python and against their SQL."""

import pytest

from folioscope.operators import ranking
from folioscope.plans import stages
from folioscope.sources import staging

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("parts", [1, 3])
def test_best_pages_of_every_task(spark, parts):
    """Against all scores: ties by id, pages that share no word left out, first pages kept whatever their score."""
    pages = [(f"p{i:03d}", " ".join(["cat"] * (i % 4) + ["dog"] * (i % 3) + [f"x{j}" for j in range(i % 5)])) for i in range(200)]
    weights, mean = [(7, "cat", 0.5), (7, "dog", 2.0), (9, "dog", 0.0), (9, "none", 1.0)], 4.0
    want = {}
    for q in (7, 9):
        for name, text in pages:
            words = text.split()
            if any(t in words for k, t, _ in weights if k == q):
                want[q, name] = round(sum(w * words.count(t) * 2.5 / (words.count(t) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for k, t, w in weights if k == q and t in words), 6)
    frame = spark.createDataFrame(pages, "chunk_id string, text string").repartition(parts)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in ranking.bm25_best(frame, weights, mean, ["p004", "p011"], depth=5, rows=16).collect()}
    assert got.items() <= want.items()
    for q in (7, 9):
        best = sorted((-s, n) for (k, n), s in want.items() if k == q)[:5]
        assert {n for _, n in best} | {n for n in ("p004", "p011") if (q, n) in want} <= {n for k, n in got if k == q}
    assert len(got) <= 2 * parts * 7


def test_counts_aliases_and_passages(spark):
    pages = spark.createDataFrame([("a", 1, 0, "Red apple red, red-apple tree"), ("b", 2, 0, "tree"), ("c", 3, 1, None), ("d", 4, 0, "  ")], "chunk_id string, doc_id long, page long, text string")
    counts = {}
    for r in ranking.word_counts(pages.coalesce(1), most=2).collect():
        n, w = counts.get(r["term"], (0, 0))
        counts[r["term"]] = n + r["pages"], w + r["words"]
    assert counts == {"red": (1, 0), "apple": (1, 0), "red,": (1, 0), "red-apple": (1, 0), "tree": (2, 0), None: (2, 6)}
    found = ranking.aliases_of(pages, {"red apple": ["e1"], "red": ["e1", "e2"], "apple tree": ["e3"], "tree": ["e4"], "tree red": ["e5"]})
    assert sorted((r["chunk_id"], r["name"], r["n"]) for r in found.collect()) == [("a", "e1", 3), ("a", "e2", 3), ("a", "e3", 2), ("a", "e4", 1), ("b", "e4", 1)]
    held = ranking.holders(pages, [(1, "apple red"), (2, "tree"), (3, "")])
    assert sorted((r["query_id"], r["doc_id"]) for r in held.collect()) == [(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (3, 4)]


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(f"{i}_p", i) for i in range(1000)], "id string, i int").repartition(7)
    got = {r["id"]: r["nth"] for r in staging.numbered(rows, "id").collect()}
    assert got == {name: k for k, name in enumerate(sorted(f"{i}_p" for i in range(1000)))}


@pytest.mark.parametrize("name", ["blocks", "chunks"])
@pytest.mark.parametrize("repeated", [False, True])
def test_pages_are_those_of_the_sql(spark, tmp_path, name, repeated):
    """Row by row where each document is one row; rows of one document are one document."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = [(900, "\n  \nTitle\n" + "x" * 50 + "\n\nlast line of the page", "en"), (901, "", "en"), (902, None, "en"), (903, "\n" * 9 + "a line far down the document", "de")]
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string"))
    if repeated:
        docs = docs.unionByName(spark.createDataFrame([(900, "\n".join(["."] * 12) + "\nmore of the same document here", "en")], "doc_id long, text string, lang string"))
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = stages.make(spark, str(tmp_path), name, {})
    sql = stages.frame(spark, str(tmp_path), stages.text_of(name, 0), {"blocks": stages.frame(spark, str(tmp_path), stages.text_of("blocks", 0))} if name == "chunks" else None)
    assert sorted(map(str, made.select(sql.columns).collect())) == sorted(map(str, sql.collect()))


def test_stages_hold_no_texts(spark):
    """Only the ranked pages carry theirs; the files are Parquet, and no shuffle files stay."""
    wide = {n for n in stages.KEPT if {"text", "term"} & set(stages.make(spark, SF, n, {}).columns)}
    assert wide <= {"ranked", "base", "word_counts"}
    assert sum(stages.make(spark, SF, n, {}).count() for n in ("word_counts", "bm25")) < 5000


def test_parts_grow_with_the_table(spark, tmp_path):
    """A fixed number of shuffle parts would let one task's memory grow with the input."""
    before = spark.conf.get(staging.PARTS, None)
    path = tmp_path / "t.parquet"
    with open(path, "wb") as f:
        f.truncate(200 << 20)
    try:
        staging.deal(spark, str(path))
        assert int(spark.conf.get(staging.PARTS)) >= 50
    finally:
        spark.conf.set(staging.PARTS, before) if before else spark.conf.unset(staging.PARTS)


@pytest.mark.parametrize("name", ["kg_edges", "grounded_page_counts", "kg_neighborhood", "mention_collect", "visual_filter", "typed_walk", "walk_supports"])
def test_graph_of_odd_rows(spark, tmp_path, name):
    """Repeated lines, an order of two customers, null keys, orders without lines, customers below, at and above the length of a walk."""
    import duckdb

    from folioscope.plans import registry

    orders = [(k, 1 + k % 3 if k < 60 else 4, f"{k % 5}-P") for k in range(64)] + [(100 + k, 5, "1-URGENT") for k in range(19)] + [(7, 2, "9-X"), (64, None, "1-P"), (65, 6, None), (66, -1, "2-P"), (None, 6, "2-P")]
    lines = [(k, (k * 7 + j) % 11, k % 4, j) for k in range(130) for j in range(1, 1 + k % 4)] + [(3, 2, 1, 1), (3, 2, 1, 1), (64, None, 2, 1), (65, None, 3, 1), (66, 5, 3, 9), (None, 1, 1, 1)]
    con = duckdb.connect()
    con.execute("create table orders (o_orderkey bigint, o_custkey bigint, o_orderpriority varchar)")
    con.execute("create table lineitem (l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int)")
    con.executemany("insert into orders values (?, ?, ?)", orders)
    con.executemany("insert into lineitem values (?, ?, ?, ?)", lines)
    for t in ("orders", "lineitem"):
        con.execute(f"copy {t} to '{tmp_path}/{t}.parquet'")
    want = con.sql(registry.SQL[name])
    got = registry.QUERIES[name](spark, str(tmp_path)).select(want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))

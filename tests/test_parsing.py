"""Walks, parsed answers and section paths worked by hand."""

from folioscope.plans import parsing, stages


def made(spark, name, tables):
    for step in name:
        text = stages.STAGES.get(step) or parsing.TEXTS[step]
        tables[step] = stages.frame(spark, "", text, tables)
    return tables[name[-1]]


def test_walk_by_hand(spark):
    """Out-edges before in-edges, each by name; a node's first place counts; nodes two steps away don't lead on; other kinds of edges aren't followed."""
    edges = [("c1", "a2", "subject_of"), ("c1", "a1", "subject_of"), ("a1", "p", "object_of"), ("a2", "p", "object_of"), ("a2", "s", "supports"), ("p", "far", "object_of"), ("a1", "no", "grounded_to"), ("z", "c1", "supports"), ("z", "a1", "supports")]
    rows = made(spark, ["steps", "walk_one", "walk_two", "walk"], {"edges": spark.createDataFrame(edges, "src string, dst string, kind string")})
    assert [r.node for r in rows.orderBy("pos").collect()] == ["c1", "a1", "a2", "z", "p", "s"]


def test_walk_is_cut(spark):
    edges = [("c1", f"a{i:02}", "subject_of") for i in range(15)] + [(f"a{i:02}", f"p{i:02}", "object_of") for i in range(15)]
    rows = made(spark, ["steps", "walk_one", "walk_two", "walk"], {"edges": spark.createDataFrame(edges, "src string, dst string, kind string")})
    assert [r.node for r in rows.orderBy("pos").collect()] == ["c1", *(f"a{i:02}" for i in range(15)), *(f"p{i:02}" for i in range(4))]


def test_triples_by_hand(spark):
    """Of five a block, counted before the empty and ungrounded go; a cut-off answer has none."""
    claims = [(i, "x", "p", f"o{i}", s) for i, s in enumerate([4, 1, 2, 3, 4, 4, 4])] + [(100 + i, "cut", "p", "o", 4) for i in range(13)]
    table = spark.createDataFrame(claims, "id long, subject string, predicate string, object string, supports long")
    assert sorted((r.block, r.nth, r.object) for r in made(spark, ["triples"], {"assertions": table}).collect()) == [("x", 0, "o0"), ("x", 3, "o3"), ("x", 4, "o4")]
    assert {r.block: (r.asked, r.parsed) for r in made(spark, ["json_array"], {"assertions": table}).collect()} == {"x": (7, 7), "cut": (13, 0)}


def test_section_path_is_a_slice(spark):
    """Depths 0, 2, 2 make the second sibling look like a child of the first."""
    table = spark.createDataFrame([(1, 0, "T", 0), (1, 3, "A", 2), (1, 5, "B", 2), (1, 9, "C", 1)], "doc_id long, ord long, text string, depth int")
    rows = made(spark, ["section_path_slice"], {"headings": table})
    assert [r.path for r in rows.orderBy("ord").collect()] == ["T", "T > A", "T > A > B", "T > C"]


def test_novelty_by_hand(spark):
    table = spark.createDataFrame([(1, 0, "user", "Ünder x"), (1, 1, "assistant", "q"), (1, 2, "user", "ünder y y"), (1, 4, "user", ""), (1, 6, "user", "x z")], "conv_id long, turn int, role string, text string")
    rows = made(spark, ["query_novelty"], {"conversations": table}).orderBy("turn").collect()
    assert [(r.jaccard_all, r.jaccard_prev, r.new_tokens) for r in rows] == [(0, 0, 1), (0.3333, 0.3333, 0.5), (0, 0, 0), (0.25, 0, 0.5)]


def test_snippets_by_role(spark):
    """Page 1 is the seed, 2 is beside it, 3 is another, 4 is expanded without a hit, 5 is another without paragraphs, 6 a seed without a hit."""
    from folioscope.plans import folds

    words = {1: ["x", "cat", "x", "dog cat", "x", "x"], 2: ["cat", "x", "dog", "x", "x", "dog"], 3: ["x", "cat", "x"], 4: ["x", "y", "z"], 5: [], 60: ["x", "y", "z"]}
    t = {
        "paras": spark.createDataFrame([(7, p, n, w, "Paragraph") for p, ws in words.items() for n, w in enumerate(ws)], "doc_id long, page long, nth long, text string, block_type string"),
        "queries": spark.createDataFrame([(1, ["cat", "dog", "cat"])], "query_id long, terms array<string>"),
        "chunks": spark.createDataFrame([(f"p{p}", 7, p, "whole") for p in words], "chunk_id string, doc_id long, page long, text string"),
        "outside": spark.createDataFrame([(1, "p4", 0.5)], "query_id long, chunk_id string, sim double"),
        "base": spark.createDataFrame([(1, f"p{p}", 7, p) for p in (1, 2, 3, 5, 60)], "query_id long, chunk_id string, doc_id long, page long"),
        "seeds": spark.createDataFrame([(1, "p1", 7, 1), (1, "p60", 7, 60)], "query_id long, chunk_id string, doc_id long, page long"),
    }
    got: dict = {}
    for r in stages.frame(spark, "", folds._SNIPPETS, t).orderBy("chunk_id", "pos").collect():
        got.setdefault(r.chunk_id, []).append((r.tag, r.text, r.score))
    assert got == {
        "p1": [("seed-core", "dog cat", 1.0), ("seed-core", "cat", 0.5), ("seed-tail", "x", 0), ("seed-tail", "x", 0)],
        "p2": [("adjacent-head", "cat", 0), ("adjacent-head", "x", 0), ("adjacent-tail", "x", 0), ("adjacent-tail", "dog", 0), ("adjacent-core", "dog", 0.5)],
        "p3": [("other-core", "cat", 0.5)],
        "p4": [("expanded-core", "x", 0), ("expanded-core", "y", 0)],
        "p5": [("other-full", "whole", 0)],
        "p60": [("seed-tail", "y", 0), ("seed-tail", "z", 0), ("seed-core", "x", 0), ("seed-core", "y", 0), ("seed-core", "z", 0)],
    }

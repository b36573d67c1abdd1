"""Folds and resampling against plain Python."""

import functools

import pandas as pd
import pytest

from folioscope.operators import evaluation, packing


def pack(spark, rows, **options):
    made = spark.createDataFrame(rows, "query_id long, chunk_id string, score double, in_base boolean, tokens long")
    return [r.chunk_id for r in packing.conditional_pack(made, **options).orderBy("pos").collect()]


def test_pack_takes_base_then_close_expansions(spark):
    rows = [(1, "a", 0.9, True, 40), (1, "b", 0.8, True, 40), (1, "c", 0.7, True, 10), (1, "x", 0.69, False, 5), (1, "y", 0.2, False, 5), (1, "e", 0.1, True, 0)]
    # 70 of 100 are used after a and b; x comes within 0.03 of c, y does not; e has no words; c fills up
    assert pack(spark, rows, budget=100) == ["a", "b", "x", "c"]
    assert pack(spark, rows, budget=100, margin=None) == ["a", "b", "x", "y", "c"]
    assert pack(spark, rows, budget=100, k=2) == ["a", "b"]
    # a base page that was passed over for its lack of words still sets the bar of the expansions
    assert pack(spark, [(1, "e", 0.99, True, 0), *rows[:5]], budget=100) == ["a", "b", "c"]


def test_pack_skips_what_does_not_fit(spark):
    assert pack(spark, [(1, "a", 0.9, True, 90), (1, "b", 0.8, True, 50), (1, "c", 0.7, True, 10)], budget=100) == ["a", "c"]
    assert pack(spark, []) == []


def test_paragraphs(spark):
    long = " ".join(["w"] * 31)
    rows = [(1, 0, 0, "Head", "Title", 0), (1, 0, 1, "one", "Paragraph", 0), (1, 0, 2, long, "Paragraph", 0), (1, 0, 3, "two", "Paragraph", 0), (1, 0, 4, " ", "Paragraph", 0), (1, 0, 5, "Next", "Header", 5)]
    made = spark.createDataFrame(rows, "doc_id long, page long, ord long, text string, block_type string, section long")
    out = packing.merge_paragraphs(made).orderBy("nth").collect()
    assert [(r.text, r.block_type, r.section, r.n) for r in out] == [("Head\none\n" + long, "Paragraph", 0, 3), ("two", "Paragraph", 0, 1), ("Next", "Header", 5, 1)]


@pytest.mark.parametrize("a,b", [("a b c d", "b d"), ("x", "y"), ("a b a b", "b a b a"), ("", "a"), ("q w e r t y", "w q r e y t")])
def test_lcs(a, b):
    x, y = a.split(), b.split()

    @functools.cache
    def brute(i, j):
        if i == len(x) or j == len(y):
            return 0
        return 1 + brute(i + 1, j + 1) if x[i] == y[j] else max(brute(i + 1, j), brute(i, j + 1))

    assert evaluation.lcs_length(x, y) == brute(0, 0)


def test_resampling(spark):
    values = [1.0] * 30 + [0.0] * 50 + [-1.0] * 10
    diffs = spark.createDataFrame(pd.DataFrame({"diff": values}))
    ci = evaluation.bootstrap_ci(diffs, times=2000).head()
    assert ci["low"] < ci["mean"] < ci["high"] and abs(ci["mean"] - 20 / 90) < 1e-6
    error = (sum((v - 20 / 90) ** 2 for v in values) / 90) ** 0.5 / 90**0.5
    assert abs((ci["high"] - ci["low"]) - 2 * 1.96 * error) < 0.04
    assert evaluation.bootstrap_ci(diffs, times=2000).head() == ci
    assert evaluation.approximate_randomization(diffs, times=2000).head()["p"] < 0.01
    level = spark.createDataFrame(pd.DataFrame({"diff": [1.0, -1.0] * 20}))
    assert evaluation.approximate_randomization(level, times=500).head()["p"] == 1.0

"""Scores and tests that SQL can't express: longest common subsequence and resampling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists."""
    row = np.zeros(len(b) + 1, np.int64)
    words = np.array(b, dtype=object)
    for w in a:
        step = np.maximum(row[1:], np.where(words == w, row[:-1] + 1, 0))
        row[1:] = np.maximum.accumulate(step)
    return int(row[-1])


@F.pandas_udf(DoubleType())
def rouge_l(gold: pd.Series, pred: pd.Series) -> pd.Series:
    """F1 of the common subsequence of normalised words; 0 if either has none or is null."""
    out = []
    for g, p in zip(gold, pred, strict=True):
        x, y = (g or "").split(), (p or "").split()
        n = lcs_length(x, y) if x and y else 0
        out.append(2 * n / (len(x) + len(y)) if n else 0.0)
    return pd.Series(out, dtype="float64")


def _strata(diffs: DataFrame) -> pd.DataFrame:
    """(diff, n): the distinct differences and their counts. Scores are rounded to four digits, which bounds them."""
    return diffs.groupBy(F.round("diff", 4).alias("diff")).agg(F.count(F.lit(1)).alias("n")).orderBy("diff").toPandas()


def _replicates(diffs: DataFrame, times: int, seed: int, draw) -> DataFrame:
    """(nth, value) of `times` replicates; each has a generator of its own, so reruns and partitionings agree."""
    table = _strata(diffs)
    values, counts = table["diff"].to_numpy(float), table["n"].to_numpy(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"nth": batch.id, "value": [draw(np.random.default_rng([seed, int(i)]), values, counts) for i in batch.id]})

    return diffs.sparkSession.range(times if len(values) else 0).mapInPandas(run, "nth long, value double")


def _resampled(rng: np.random.Generator, values: np.ndarray, counts: np.ndarray) -> float:
    n = counts.sum()
    return float(rng.multinomial(n, counts / n) @ values / n)


def _swapped(rng: np.random.Generator, values: np.ndarray, counts: np.ndarray) -> float:
    return float((2 * rng.binomial(counts, 0.5) - counts) @ values / counts.sum())


def bootstrap_ci(diffs: DataFrame, times: int = 10_000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """(diff) -> (mean, low, high): percentile interval of the mean of paired differences.

    Equal differences are drawn together by a multinomial, which is the same distribution as drawing rows.
    """
    tail = (1 - level) / 2
    made = _replicates(diffs, times, seed, _resampled).agg(F.percentile("value", tail).alias("low"), F.percentile("value", 1 - tail).alias("high"))
    return diffs.agg(F.round(F.avg("diff"), 6).alias("mean")).crossJoin(made)


def stars(p: Column) -> Column:
    """Marks of significance at 0.001, 0.01 and 0.05."""
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("(n.s.)")


def approximate_randomization(diffs: DataFrame, times: int = 10_000, seed: int = 42) -> DataFrame:
    """(diff) -> (delta, p, stars): share of random swaps of the two systems whose mean difference is as large."""
    delta = diffs.agg(F.abs(F.avg("diff")).alias("delta"))
    swaps = _replicates(diffs, times, seed, _swapped)
    return swaps.crossJoin(delta).groupBy("delta").agg(F.avg((F.abs("value") >= F.col("delta") - 1e-12).cast("double")).alias("p")).withColumn("stars", stars(F.col("p")))

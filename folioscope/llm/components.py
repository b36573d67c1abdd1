"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Stages, sized

#: A hub's rows are dealt to so many tasks.
SALT = 64


def _with_least(rows: DataFrame, least: DataFrame, edges: int) -> DataFrame:
    """rows (u, v) with m, the entry of least (u, n, m) for u.

    A hub, whose n exceeds the ten-thousandth of all edges, is dealt to SALT tasks: its rows by a hash of v, its entry
    to all of them. There are at most 20,000 hubs, so that their names are broadcast.
    """
    small = least.select("u", "m")
    if least.count() <= 1_000_000:
        return rows.join(F.broadcast(small), "u")
    hub = F.col("n") > max(100_000, edges // 10_000)
    hubs = F.broadcast(least.where(hub).select("u", F.lit(True).alias("hub")))
    dealt = rows.join(hubs, "u", "left").withColumn("salt", F.when(F.col("hub"), F.pmod(F.xxhash64("v"), F.lit(SALT))).otherwise(F.lit(0).cast("long"))).drop("hub")
    copies = F.when(hub, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(least.select("u", "m", F.explode(copies).cast("long").alias("salt")), ["u", "salt"]).drop("salt")


def components(edges: DataFrame, stages: Stages, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) -> (node, comp): comp is the smallest node of the component; nodes without edges don't appear.

    Each round lets every node hand its larger neighbours (then its smaller ones) to its smallest neighbour. Minima
    are partial aggregates and hubs are dealt to many tasks. Rounds end when nothing changes, which takes about log2 of
    the longest path; each is a table in the shared folder, deleted when the next is there.
    """

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        out = stages.keep(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h")))
        return out, (seen.get["n"], seen.get["h"])

    def least_of(rows: DataFrame, m) -> DataFrame:
        return stages.keep(rows.groupBy("u").agg(F.count(F.lit(1)).alias("n"), m.alias("m")))

    pairs, sig = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while True:
        # large star: larger neighbours of a node meet the smallest of itself and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = least_of(both, F.least(F.min("v"), F.first("u")))
        large = stages.keep(_with_least(both.where(F.col("v") > F.col("u")), least, 2 * sig[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        stages.drop(least)
        # small star: a node and its smaller neighbours meet the smallest of them
        least = least_of(large, F.min("v"))
        small = _with_least(large, least, sig[0]).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        new, now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        stages.drop(least, large, pairs)
        # done when every node has one edge, to a node that has none: both edge sets agree
        pairs, sig, before = new, now, sig
        if now == before:
            break
    out = stages.keep(pairs.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()))
    stages.drop(pairs)
    return out

"""Mixing sources to target weights by a low-discrepancy source schedule. DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages, sized

WORDS = r"[^\x20\x09-\x0D]+"
#: Fractional part of the golden ratio.
GOLDEN = (math.sqrt(5) - 1) / 2


def n_words(text: Column) -> Column:
    """Words of a text as long; null and empty texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with target: share of all sizes by weight, capped at most times the size.

    Weights repeat over the sources by code point, null last. Filling up: the sources in order of cap per weight; the
    first whose level, what the capped ones before it leave over the weights from it on, is within its own cap sets
    the level of all. One row per source, so one window over all of them; the number of sources is the number of
    entries of the mixture, not of rows.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    named = totals.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("cap_before")) / F.col("weight_left")
    return (
        named.withColumn("cap_before", F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything))
        .withColumn("target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))))
        .select("source", "source_size", "weight", "target")
    )


def schedule(goals: DataFrame, n_slots: int, chunk: int = 65_536) -> DataFrame:
    """(source, source_size, target) -> (source, slot, rank, lo, hi): the slots of each source and their token ranges.

    Slot j is the point frac((j + 1) * golden ratio); the source whose stretch of cumulative target shares holds the
    point gets the slot. Ranks count a source's slots in order, chunk by chunk, so that no source, however hot, is
    ranked in one task. A source's slots cut its target into equal blocks of tokens [lo, hi). A source too small for
    any point gets one slot after all others (slot n_slots), so that it takes part.
    """
    spark = goals.sparkSession
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    wanted = goals.where(F.round("target") > 0)
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("target").over(Window.partitionBy())
    stretch = wanted.withColumn("to", upto / whole).withColumn("from", (upto - F.col("target")) / whole)
    # points and stretches meet on a grid of cells: an equi-join, whatever the number of sources
    cells = 1024
    cell = F.explode(F.sequence(F.floor(F.col("from") * cells), F.least(F.floor(F.col("to") * cells), F.lit(cells - 1).cast("long"))))
    grid = stretch.select("source", "from", "to", cell.alias("cell"))
    point = F.col("id") + 1
    points = spark.range(n_slots).withColumn("u", point * F.lit(GOLDEN) - F.floor(point * F.lit(GOLDEN))).withColumn("cell", F.floor(F.col("u") * cells))
    hit = points.join(grid, "cell").where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to"))).select("source", F.col("id").alias("slot"), F.floor(F.col("id") / chunk).alias("chunk"))
    counts = hit.groupBy("source", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("source", "chunk", (F.sum("n").over(Window.partitionBy("source").orderBy("chunk")) - F.col("n")).alias("before"))
    s, b = hit.alias("s"), before.alias("b")
    ranked = s.join(b, F.col("s.source").eqNullSafe(F.col("b.source")) & (F.col("s.chunk") == F.col("b.chunk"))).select(
        "s.source", "slot", (F.row_number().over(Window.partitionBy("s.source", "s.chunk").orderBy("slot")) - 1 + F.col("before")).alias("rank")
    )
    number = counts.groupBy("source").agg(F.sum("n").alias("n_slots"))
    g, m = wanted.alias("g"), number.alias("m")
    full = g.join(m, F.col("g.source").eqNullSafe(F.col("m.source")), "left").select("g.source", F.round("target").cast("long").alias("tokens"), F.col("n_slots"))
    r, f = ranked.alias("r"), full.alias("f")
    late = full.where(F.col("n_slots").isNull()).select("source", F.lit(n_slots).cast("long").alias("slot"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("lo"), F.col("tokens").alias("hi"))
    edge = lambda k: F.floor(k * F.col("tokens") / F.col("n_slots"))
    cut = r.join(f, F.col("r.source").eqNullSafe(F.col("f.source"))).select("r.source", "slot", "rank", edge(F.col("rank")).alias("lo"), F.when(F.col("rank") + 1 == F.col("n_slots"), F.col("tokens")).otherwise(edge(F.col("rank") + 1)).alias("hi"))
    return cut.unionByName(late)


def shuffled_stream(sizes: DataFrame, seed: str, buckets: int, group: int = 4096) -> DataFrame:
    """Adds lo, the place of each row's first token in its source's stream of rows shuffled by md5.

    Prefix sums in three steps, within buckets of the shuffle key, over the buckets of a group and over the groups of a
    source, so that a source with a third of all rows is summed by many tasks. Ties of the key go by doc_id and size; rows equal in both may
    swap, which changes nothing.
    """
    key = F.coalesce(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed))), F.lit(""))
    part = F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32))
    keyed = sizes.withColumn("key", key).withColumn("part", part)
    own = Window.partitionBy("source", "part").orderBy("key", "doc_id", "size")
    local = keyed.withColumn("own", F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).withColumn("nth", F.row_number().over(own))
    # of buckets, in groups of them; of groups, of which a source has one for some eight million rows
    parts = keyed.groupBy("source", "part").agg(F.sum("size").alias("n")).withColumn("group", F.floor(F.col("part") / group))
    groups = parts.groupBy("source", "group").agg(F.sum("n").alias("n"))
    groups = groups.select("source", "group", (F.sum("n").over(Window.partitionBy("source").orderBy("group")) - F.col("n")).alias("base"))
    inner = parts.withColumn("inner", F.sum("n").over(Window.partitionBy("source", "group").orderBy("part")) - F.col("n"))
    x, y = inner.alias("x"), groups.alias("y")
    before = x.join(y, F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.group") == F.col("y.group"))).select("x.source", "part", (F.col("inner") + F.col("base")).alias("before"))
    a, b = local.alias("a"), before.alias("b")
    return a.join(b, F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.part"))).select("a.*", (F.col("own") + F.col("before")).alias("lo"))


def mix(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, block_tokens: int = 4096, seed: str = "mix", rows_per_bucket: int = 2_000) -> DataFrame:
    """(doc_id, source, size) -> (doc_id, source, size, source_size, target, taken, first_slot, n_blocks).

    Each source's rows, shuffled, are a stream of tokens that is read at most `most` times; the schedule's slots cut
    the stream read so far into equal blocks, and a row is taken as many tokens as its places in the stream share with
    scheduled blocks. The mixture is the blocks in the order of their slots, in which every stretch holds the sources
    about in proportion to their targets: first_slot is where a row first appears in it (null if nothing is taken), and
    n_blocks counts the blocks that hold some of it. Taken tokens of a source sum to its target rounded to a whole
    token. No row exceeds most times its size, since a target never exceeds most times the source's size.

    Null sources are a source of their own, the last. Rows of size 0 take 0. Repeated rows count each. An empty table
    gives no rows. Very long rows spread over many blocks. Further columns are ignored, whatever their names. The order in
    the stream depends on doc_id and size alone, so reruns agree.
    """
    with Stages(sizes.sparkSession) as stages:
        sizes = stages.keep(sizes.select("doc_id", "source", F.col("size").cast("long").alias("size")))
        totals = stages.keep(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
        size = totals.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("n_rows"), F.lit(0))).head()
        goals = stages.keep(targets(totals.drop("n_rows"), weights, share, float(most)))
        slots = stages.keep(schedule(goals, max(1, math.ceil(share * size[0] / block_tokens))))
        stream = stages.keep(shuffled_stream(sizes, seed, max(1, size[1] // rows_per_bucket)))
        stages.drop(sizes)
        placed = stream.alias("s").join(sized(goals, 100_000).alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.*", "source_size", "target")
        # the places of a row in each reading of the stream, by the blocks they can touch
        per_source = stages.keep(slots.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("hi").alias("tokens")))
        seen = placed.where(F.col("size") > 0).alias("s").join(sized(per_source, 100_000).alias("p"), F.col("s.source").eqNullSafe(F.col("p.source"))).select("s.*", "n", "tokens", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("reading"))
        seen = seen.withColumn("at", F.col("lo") + F.col("reading") * F.col("source_size")).where(F.col("at") < F.col("tokens"))
        first, last = F.floor(F.col("at") * F.col("n") / F.col("tokens")), F.floor((F.least(F.col("at") + F.col("size"), F.col("tokens")) - 1) * F.col("n") / F.col("tokens"))
        pieces = seen.withColumn("rank", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.col("n") - 1)))).select("source", "part", "nth", "size", "at", "rank")
        x, y = pieces.alias("x"), slots.alias("y")
        common = F.least(F.col("x.at") + F.col("size"), F.col("hi")) - F.greatest(F.col("x.at"), F.col("y.lo"))
        got = x.join(y, F.col("x.source").eqNullSafe(F.col("y.source")) & (F.col("x.rank") == F.col("y.rank"))).select("x.source", "part", "nth", "slot", common.alias("common")).where("common > 0")
        got = got.groupBy("source", "part", "nth").agg(F.sum("common").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_blocks"))
        a, b = placed.alias("a"), got.alias("b")
        same = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.nth") == F.col("b.nth"))
        none = F.lit(0).cast("long")
        return stages.result(a.join(b, same, "left").select("doc_id", "a.source", "size", "source_size", "target", F.coalesce("taken", none).alias("taken"), "first_slot", F.coalesce("n_blocks", none).alias("n_blocks")))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """mix() over documents (doc_id, source, text), the size of a document being its number of words."""
    return mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), **options)


#: What mix() takes in closed form, and the schedule point by point, as DuckDB SQL over the table named {docs}.
MIX_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cap_before,
  sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left, 1.5::DOUBLE * (sum(source_size) OVER ()) AS total FROM w),
l AS (SELECT max((total - cap_before) / weight_left) AS level FROM f WHERE (total - cap_before) / weight_left * weight <= cap),
t AS MATERIALIZED (SELECT source, source_size, least(cap, coalesce(level * weight, cap)) AS target, round(least(cap, coalesce(level * weight, cap)))::BIGINT AS tokens FROM f CROSS JOIN l),
p AS (SELECT doc_id, source, size, sum(size) OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '') || 'mix'), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS lo FROM d),
k AS (SELECT source, (upto - target) / whole AS lo, upto / whole AS hi FROM (SELECT source, target, sum(target) OVER (ORDER BY source IS NULL, source) AS upto, sum(target) OVER () AS whole FROM t WHERE tokens > 0) x),
n AS (SELECT greatest(1, ceil(1.5::DOUBLE * sum(source_size) / 4096))::BIGINT AS slots FROM s),
j AS (SELECT unnest(range((SELECT slots FROM n))) AS slot),
u AS (SELECT slot, (slot + 1) * 0.6180339887498949::DOUBLE - floor((slot + 1) * 0.6180339887498949::DOUBLE) AS u FROM j),
h AS (SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS r, count(*) OVER (PARTITION BY source) AS m FROM u JOIN k ON u >= lo AND u < hi),
b AS (SELECT h.source, slot, floor((r * tokens)::DOUBLE / m)::BIGINT AS lo, CASE WHEN r + 1 = m THEN tokens ELSE floor(((r + 1) * tokens)::DOUBLE / m)::BIGINT END AS hi FROM h JOIN t ON t.source IS NOT DISTINCT FROM h.source
  UNION ALL SELECT t.source, slots, 0, tokens FROM t CROSS JOIN n WHERE tokens > 0 AND NOT EXISTS (SELECT 1 FROM h WHERE h.source IS NOT DISTINCT FROM t.source)),
q AS (SELECT p.doc_id, p.source, p.size, t.source_size, t.target, p.lo,
  (greatest(0, least(lo + size, tokens) - lo) + greatest(0, least(lo + source_size + size, tokens) - lo - source_size))::BIGINT AS taken FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT q.doc_id, q.size, q.source_size, q.target, q.taken, CASE WHEN q.size > 0 THEN b.slot END AS first_slot
FROM q LEFT JOIN b ON coalesce(b.source, '') = coalesce(q.source, '') AND (b.source IS NULL) = (q.source IS NULL) AND q.lo >= b.lo AND q.lo < b.hi AND q.size > 0
"""

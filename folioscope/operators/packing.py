"""Packing pages under a token budget and blocks into paragraphs, as folds over sorted arrays.

Both are built-in higher-order functions: a query's candidates (bounded by the retrieval depth) or a segment's blocks
(bounded by a page) become one sorted array, and `aggregate` carries the state along it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def conditional_pack(candidates: DataFrame, k: int = 20, budget: int = 4500, base_share: float = 0.7, margin: float | None = 0.03, most_expanded: int = 2) -> DataFrame:
    """(query_id, chunk_id, score, in_base, tokens) -> (query_id, chunk_id, pos) in packing order.

    Base pages first until k are packed or the base share of the budget is used, then up to `most_expanded` other pages
    whose score comes within `margin` of the next unpacked base page (any score if margin is None), then base pages
    again. Pages without words and pages over the rest of the budget are skipped. Ties are broken by chunk_id.

    Every page is offered in the phases it may enter, in one array: base (the first 2k), other, base. What a phase admits
    depends only on the state so far, so phases need no loops of their own.
    """
    page = F.struct((-F.col("score")).alias("rank"), F.col("chunk_id").alias("id"), "in_base", "score", "tokens")
    pages = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    near = "true" if margin is None else f"coalesce(o.p.score >= element_at(filter(base, b -> not array_contains(s.ids, b.id)), 1).score - {margin}D, true)"
    room = "o.p.tokens > 0 and s.used + o.p.tokens <= {budget} and size(s.ids) < {k} and not array_contains(s.ids, o.p.id)".format(budget=budget, k=k)
    admits = f"case o.phase when 1 then s.used < {int(base_share * budget)} when 2 then s.extra < {most_expanded} and {near} else s.used < {budget} end"
    fold = f"""aggregate(offers, named_struct('used', 0L, 'extra', 0, 'ids', cast(array() as array<string>)),
      (s, o) -> if({room} and {admits}, named_struct('used', s.used + o.p.tokens, 'extra', s.extra + if(o.phase = 2, 1, 0), 'ids', array_append(s.ids, o.p.id)), s), s -> s.ids)"""
    offers = f"""concat(transform(slice(base, 1, {2 * k}), p -> struct(1 as phase, p)), transform(filter(pages, p -> not p.in_base), p -> struct(2 as phase, p)), transform(base, p -> struct(3 as phase, p)))"""
    packed = pages.withColumn("base", F.expr("filter(pages, p -> p.in_base)")).withColumn("offers", F.expr(offers)).select("query_id", F.posexplode(F.expr(fold)).alias("pos", "chunk_id"))
    return packed.select("query_id", "chunk_id", (F.col("pos") + 1).cast("long").alias("pos"))


def merge_paragraphs(blocks: DataFrame, least_tokens: int = 40) -> DataFrame:
    """(doc_id, page, ord, text, block_type, section) -> paragraphs (doc_id, page, nth, text, block_type, section, n).

    A new paragraph begins at a heading, at a change to another non-null section, and once one has `least_tokens`
    estimated tokens. Its type is the most frequent one, the first of them in a tie. Blank blocks are left out.

    Headings and changes of section cut a page into segments, which windows find; only the count of words, which starts
    anew with every paragraph, is a fold over a segment's words.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("ord")
    heading = F.col("block_type").isin("Header", "Title")
    rows = blocks.where(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "").withColumn("heading", heading)
    told = F.when(heading | F.col("section").isNotNull(), F.struct("section"))
    rows = rows.withColumn("now", F.last(told, ignorenulls=True).over(page.rowsBetween(Window.unboundedPreceding, 0))["section"])
    rows = rows.withColumn("before", F.lag("now").over(page))
    cut = heading | (F.col("section").isNotNull() & ~F.col("section").eqNullSafe(F.col("before")))
    rows = rows.withColumn("segment", F.sum(cut.cast("int")).over(page))
    words = F.size(F.split(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")), " "))
    kept = F.array_sort(F.collect_list(F.struct("ord", "text", "block_type", words.alias("words"))))
    segments = rows.groupBy("doc_id", "page", "segment").agg(F.first("now").alias("section"), kept.alias("own"))
    # the place of each block's paragraph within the segment
    fold = f"""aggregate(own, named_struct('words', 0, 'nth', 0, 'out', cast(array() as array<int>)),
      (s, b) -> named_struct('words', if(int((s.words + b.words) * 1.3D) >= {least_tokens}, 0, s.words + b.words), 'nth', s.nth + if(int((s.words + b.words) * 1.3D) >= {least_tokens}, 1, 0), 'out', array_append(s.out, s.nth)), s -> s.out)"""
    dealt = segments.withColumn("places", F.expr(fold)).select("doc_id", "page", "segment", "section", F.explode(F.arrays_zip("own", "places")).alias("z"))
    dealt = dealt.select("doc_id", "page", "segment", "section", F.col("z.places").alias("place"), F.col("z.own").alias("b"))
    kinds = Window.partitionBy("doc_id", "page", "segment", "place", "b.block_type")
    dealt = dealt.withColumn("vote", F.struct(F.count(F.lit(1)).over(kinds).alias("n"), (-F.min("b.ord").over(kinds)).alias("first"), F.col("b.block_type").alias("kind")))
    made = dealt.groupBy("doc_id", "page", "segment", "place").agg(
        F.first("section").alias("section"), F.count(F.lit(1)).alias("n"), F.max("vote")["kind"].alias("block_type"), F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["text"]), "\n").alias("text")
    )
    nth = (F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("segment", "place")) - 1).cast("long")
    return made.select("doc_id", "page", nth.alias("nth"), "text", "block_type", "section", "n")

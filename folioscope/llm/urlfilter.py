"""URL filters: rules by host and path, and trust propagated over the host graph. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, sized

ALLOW, BLOCK = "allow", "block"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(_ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest of the (verdict, host, path) rules that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's. Rules of one length go by name.
    The rules are a literal of the plan: a few entries, sized by whoever writes them.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2]) for r in ordered]
    return F.coalesce(*[F.when(f, F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for f, r in zip(fits, ordered, strict=True)])


def host_edges(pages: DataFrame, parents: bool = True) -> DataFrame:
    """(url, html) -> weighted edges (src, dst, weight) between hosts; no edge from a host to itself.

    A link counts for the host of its absolute target, relative ones stay on their own host and add nothing. With
    parents, a host and its parent domain (the name without its first label, while two labels remain) link each other
    once: whoever runs the domain runs the subdomain.
    """
    href = r"(?is)href\s*=\s*[\"']?([a-z][a-z0-9+.-]*://[^\"'\s>]*)"
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(href), F.lit(1))).alias("to"))
    edges = links.select("src", host_of(F.col("to")).alias("dst"))
    if parents:
        hosts = pages.select(host_of(F.col("url")).alias("h")).distinct()
        labels = F.split("h", r"\.")
        depth = F.greatest(F.size(labels) - 2, F.lit(0))
        # every suffix of the name down to two labels, each linked with the next
        names = hosts.where(F.size(labels) > 2).select(F.explode(F.transform(F.sequence(F.lit(1), depth), lambda k: F.struct(F.concat_ws(".", F.slice(labels, k, F.size(labels))).alias("c"), F.concat_ws(".", F.slice(labels, k + 1, F.size(labels))).alias("p")))).alias("e"))
        up = names.select(F.col("e.c").alias("src"), F.col("e.p").alias("dst")).distinct()
        edges = edges.unionByName(up).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.where((F.col("src") != F.col("dst")) & (F.col("src") != "") & (F.col("dst") != "")).groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def personalised_rank(edges: DataFrame, seeds: DataFrame, stages: Stages, rounds: int = 8, damping: float = 0.85) -> DataFrame:
    """(src, dst, weight), (host, mass) -> (host, score): rank that restarts at the seeds, in proportion to their mass.

    A round sums by target with partial sums before the shuffle, so a host that everyone links stays cheap. Mass of
    hosts without links out returns to nobody. Lineage is cut each second round.
    """
    out = edges.groupBy("src").agg(F.sum("weight").alias("out"))
    steps = stages.keep(edges.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("p")))
    masses = stages.keep(seeds.groupBy("host").agg(F.sum("mass").alias("mass")).where(F.col("mass") > 0))
    restart = masses.select("host", (F.col("mass") / masses.agg(F.sum("mass")).scalar()).alias("mass"))
    rank = restart.select("host", F.col("mass").alias("score"))
    held = None
    for k in range(rounds):
        moved = steps.join(rank, steps["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.lit(damping) * F.col("p") * F.col("score")).alias("score"))
        rank = moved.unionByName(restart.select("host", (F.lit(1 - damping) * F.col("mass")).alias("score"))).groupBy("host").agg(F.sum("score").alias("score"))
        if k % 2 or k + 1 == rounds:
            rank = stages.keep(rank)
            if held is not None:
                stages.drop(held)
            held = rank
    stages.drop(steps, masses)
    return rank


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], rounds: int = 8, damping: float = 0.85, margin: float = 0.0, parents: bool = True) -> DataFrame:
    """(page_id, url, html) -> (page_id, host, path, rule, verdict, trust, distrust), one row per page.

    Seeds are the hosts of the pages that rules allow and block, by number of pages. Trust follows links from the
    allowed hosts, distrust follows them backwards from the blocked ones (who links a blocked host is suspect). A page
    without a rule is blocked when its host's distrust exceeds its trust by more than margin and 1e-9 of the larger
    score: a host's share of all mass shrinks as tables grow, so no fixed number of digits tells it from 0. Null urls,
    and hosts that nothing reaches, are allowed. Of rules that fit, the longest wins, and of equally long ones the first by
    name. Repeated pages count each and keep their rows, an empty table gives no rows, and further columns are ignored.
    """
    with Stages(pages.sparkSession) as stages:
        pages = pages.select("page_id", "url", "html")
        found = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        found = stages.keep(found.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict")))
        edges = stages.keep(host_edges(pages, parents))
        hosts = found.where((F.col("host") != "") & F.col("verdict").isNotNull()).groupBy("host", "verdict").agg(F.count(F.lit(1)).cast("double").alias("mass"))
        trust = personalised_rank(edges, hosts.where(F.col("verdict") == ALLOW), stages, rounds, damping)
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        distrust = personalised_rank(back, hosts.where(F.col("verdict") == BLOCK), stages, rounds, damping)
        scores = trust.withColumnRenamed("score", "trust").join(distrust.withColumnRenamed("score", "distrust"), "host", "full").na.fill(0.0, ["trust", "distrust"])
        scores = sized(stages.keep(scores))
        good, bad = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
        by_method = F.when(bad - good > margin + 1e-9 * F.greatest(good, bad), BLOCK).otherwise(ALLOW)
        return stages.result(found.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", by_method).alias("verdict"), good.alias("trust"), bad.alias("distrust")))

"""Connected components by alternating large-star and small-star steps on a table of links.

Every step is a grouped minimum, combined before the shuffle, and a join on the node and a salt, so no task
needs all links of a node and no link passes through the driver. The rounds are logarithmic in the longest
path in practice. Each round's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, salted_join


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node links to the smallest in its neighbourhood."""
    both = _both_ways(links)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return salted_join(both.filter("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours link to the smallest of them. Rows hold a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    down = salted_join(links, least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b")
    return down.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame, label: str = "components") -> DataFrame:
    """node, component (its smallest node) for every node of links(a, b); self links and nulls are ignored."""
    at = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(at)
    while seen[0]:
        before, at = at, materialise(_small_star(_large_star(at).filter("a > b")), label)
        now = mark(at)
        release(before)
        if now == seen:
            break
        seen = now
    out = materialise(at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(at.select("b", "b").distinct()), label)
    release(at)
    return out

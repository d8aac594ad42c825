"""Connected components of a link table, by rounds of large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import discard, written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node reachable.

    Each step re-hangs every node's neighbours on the least of them; nothing is collected. The links go to
    the shared folder after each round, which deletes the table of the round before, and the steps end when a round changes nothing: after
    about log2(n) squared of them at most."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        last = edges
        edges = written(small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(small.select("a", F.col("m").alias("b"))).distinct(), "links")
        discard(last)
        after = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == after:
            break
        before = after
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

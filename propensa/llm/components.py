"""Connected components of a table of links, by alternating stars, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from propensa.session import cut_lineage


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest vertex around."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    tied = both.where("b > a").join(least.hint("rebalance"), "a")
    return tied.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    """Of links that lead down from a vertex, all ends are tied to the smallest one."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a")
    others = tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the links (a, b) but the roots; the root is the smallest vertex."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state = cut_lineage(links, "links")
    seen = None
    while True:
        state = cut_lineage(_small_star(_large_star(state)), "stars")
        mark = state.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == (mark["n"], mark["x"]):
            return state.select(F.col("a").alias("v"), F.col("b").alias("root"))
        seen = (mark["n"], mark["x"])

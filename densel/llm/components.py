"""Connected components of links that stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from densel.llm.tables import written


def _directed(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link each node's larger neighbours to the smallest node of its neighbourhood."""
    both = _directed(edges)
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link each node and its smaller neighbours to the smallest of them. ``edges`` run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``links`` (a, b; longs), for every node with a link.

    Alternates large-star and small-star steps, which keep connectivity and turn each component into a
    star in a logarithmic number of rounds; each round is written to the shared folder. Self-links and
    repeated links do no harm; nodes that only link to themselves get no row.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                    "links")
    mark = None
    while True:
        r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if (now := (r[0], r[1])) == mark or not r[0]:
            break
        mark = now
        edges = written(_small_star(_large_star(edges).distinct()).distinct(), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

"""Connected components of a graph that is never gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobloom.session import shared_folder


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; the root is the smallest node of the component.

    Neighbours are hung below the smallest of them, larger ones first, then smaller ones, until
    the edges are stars. A round is two grouped minima, counted partially before the shuffle;
    rounds are cut off by reliable checkpoints.
    """
    shared_folder(edges.sparkSession)
    links = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    state = None
    while True:
        links = _small_star(_large_star(links)).checkpoint()
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).head()
        if (now["n"], now["h"]) == state:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                links.select("b", "b").distinct()
            )
        state = (now["n"], now["h"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", "m")).distinct()

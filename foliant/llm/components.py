"""Connected components of an edge table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the undirected ``edges`` (columns a, b): root is the smallest node reached.

    Rounds of large-star and small-star steps: each node passes its smallest neighbour on to the larger ones,
    then to the smaller ones, until nothing changes. A node with many neighbours only meets a minimum, which
    is aggregated before the shuffle; its edges stay spread by Spark's skewed joins. Loops and repeated edges
    are ignored; an empty table gives an empty result. Joins are merged, whatever Spark guesses of their size, so
    that the driver never holds a table of nodes. Each round's edges are a table that goes after the next round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, drop = stored(edges)
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least.hint("merge"), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least.hint("merge"), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last = drop
        edges, drop = stored(moved.union(least).distinct())
        last()
        state = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (state.n, state.x) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
        before = (state.n, state.x)

"""Connected components of a graph of links, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeframe.session import staged


def _stars(edges: DataFrame) -> DataFrame:
    """Point every node to the least node around it: first its larger neighbours (large star), then the
    smaller ones (small star). Each keeps the components; repeating both makes every component a star."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.groupBy("a").agg(F.min("b").alias("m"))
    return (large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
            .unionAll(down.select("a", F.col("m").alias("b"))).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a long, b long); root is the component's least node.

    Each round is written, so lineage stays short; the number of rounds grows with the logarithm of the
    longest chain. A node that many links point to is one pre-aggregated row and a join key whose rows
    adaptive execution may split.
    """
    now = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        # A star forest: every node has one edge and no root has an edge of its own.
        twice = now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1)
        chained = now.join(now.select(F.col("a").alias("b")), "b", "left_semi").limit(1)
        if not twice.select("a").unionAll(chained.select("a")).take(1):
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = staged(_stars(now), "links")

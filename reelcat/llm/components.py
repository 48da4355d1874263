"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelcat.llm.common import settle


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links`` (a, b: not null, of one type that has an order).

    Each round takes the smallest root among a node's neighbours, then its root's root,
    so the rounds grow with the logarithm of the longest path.  Roots are written to the
    shared checkpoint folder after each round; the driver sees one count a round.
    A node with very many links is spread by partial aggregation and split joins.
    """
    both = settle(links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a")).distinct())
    roots = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(roots, both["b"] == roots["node"]).groupBy("a").agg(F.min("root").alias("near"))
        better = roots.join(near, roots["node"] == near["a"]).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("of"), F.col("root").alias("far"))
        after = settle(better.join(jump, better["root"] == jump["of"]).select("node", F.least("root", "far").alias("root"), "old"))
        roots = after.select("node", "root")
        if not after.where("root <> old").limit(1).count():
            return roots

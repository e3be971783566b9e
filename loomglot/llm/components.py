"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, compact


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of every node with the least of them: the greater ones (large star) or the smaller ones and the node
    itself (small star). ``edges`` hold ``a > b``."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = around.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the links ``a, b`` (bigint): the least node of its component.

    Each round runs one large and one small star and is written to the checkpoint folder; it ends when nothing changes, after a number of
    rounds that grows with the logarithm of the longest path. No list of neighbours is gathered: stars are minima and joins.
    """
    edges = compact(checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()))
    before = None
    for _ in range(most_rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or mark[0] == 0:
            break
        before = mark
        edges = compact(checkpointed(_star(_star(edges, True), False)))
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("b").agg(F.lit(1).alias("n")).select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)

"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxframe.llm import common


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long); root is the least node it reaches.

    Each step is a grouped minimum, combined before the shuffle, and a join by node. A node's neighbours meet in
    one task: nodes with many are not split. Each round is written to the shared folder. The number of rounds grows with the
    logarithm of the longest path. Loops and repeated edges change nothing; no edges give an empty table.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(most_rounds):
        edges = common.written(edges, "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
        if before is not None and (now["n"], now["h"]) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b"), F.col("b")).distinct())
        before = (now["n"], now["h"])
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hooked = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = hooked.union(small.select("a", F.col("m").alias("b"))).distinct()
    raise RuntimeError("components did not settle")

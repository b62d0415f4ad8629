"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import drop_staged, staged


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node that can be reached.

    Each round links every node to the least of its neighbours. Minima are pre-aggregated before the shuffle and
    staged, so that both sides of the join back on a node come from a shuffle alone: only then can Spark split a node
    with very many neighbours, once its share of a partition passes spark.sql.adaptive.skewJoin's thresholds. Rounds
    grow with the logarithm of a component's size. Each round's tables are staged, so a lost executor costs one round
    at most. No edges give no rows.
    """
    current = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _signature(current)
    for _ in range(most_rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = staged(large, "edges")
        drop_staged(least)
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(least, "a")
        small = joined.select(F.greatest("b", "m").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        following = staged(small.filter("a <> b").distinct(), "edges")
        drop_staged(current, large, least)
        current, before, seen = following, seen, _signature(following)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())

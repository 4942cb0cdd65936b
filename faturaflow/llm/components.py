"""Connected components of an edge table by alternating large and small stars.

Every round is two group-by passes over the edges; the edges of a round are written to the
shared folder, so the lineage stays short. The rounds grow with the logarithm of the longest
chain. A node with very many neighbours is never collected: its smallest neighbour comes from an aggregate that is combined
before the shuffle, and is written, so that the join which hangs the others on it is one of two plain tables and is split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faturaflow.llm.common import written


def _state(edges: DataFrame):
    """Count and hash sum of the edges: equal before and after a round only at the fixed point."""
    return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) to (node, component): the smallest node that each node with an edge can reach."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges", small=True)
    seen = _state(now)
    for _ in range(rounds if seen[0] else 0):
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "low", small=True)
        # Large star: larger neighbours of a node hang on its smallest neighbour.
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b")
        # Small star: a node and its smaller neighbours hang on the smallest of them.
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least", small=True)
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = written(small.filter("a <> b").distinct(), "edges", small=True)
        if (state := _state(now)) == seen:
            break
        seen = state
    else:
        if seen[0]:
            raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)

"""Connected components by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelshelf.llm.common import cut, drop_cut


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked to the least of u and its neighbours."""
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b: long, a != b); label is the component's least node.

    Minima are partly aggregated before each shuffle, joins on hub nodes can be split at run time, and each round
    is written to the shared folder, so the plan stays short. The number of rounds grows with the logarithm of
    the longest path.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        new = cut(_small_star(_large_star(now)), "edges")
        # Decimal sums don't overflow; the same edges give the same mark.
        seen = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        drop_cut(now)
        now = new
        if (seen.n, seen.h) == mark:
            break
        mark = (seen.n, seen.h)
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("label")))

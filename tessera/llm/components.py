"""Connected components by alternating large and small stars.

Each round is two aggregations and joins on edges; partial aggregation takes the
smallest neighbour of a vertex with very many, and no vertex's edges ever meet
in one task. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written

ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row.n, row.h or 0


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b): node and component, the smallest node reachable, for each node
    with a link. Loops, repeated and reversed links change nothing."""
    pair = lambda a, b: [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]
    edges = written(links.where(F.col("a") != F.col("b")).select(*pair("a", "b")).distinct())
    state = _state(edges)
    for _ in range(ROUNDS):
        if not state[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where(F.col("b") != F.col("m")).select(*pair("b", "m")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = written(small.distinct())
        now = _state(edges)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())

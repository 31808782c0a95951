"""Connected components by alternating large and small stars, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h")).first()
    return row["n"], row["h"] or 0


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): root is the smallest node reachable. edges: (a, b) of any orderable type, loops and repeats allowed.

    Each round links every node's larger neighbours to its smallest one (large star) and then its smaller neighbours
    to the smallest one (small star). Minima are aggregated on the map side and joined back, so that a hub with a large
    share of all edges is never gathered; adaptive execution splits its side of the join. Every round is written to the
    shared folder. Nodes without edges aren't returned; an empty table gives an empty table.
    """
    now = scratch.save(
        edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        # the larger neighbours of u are the a of the stored edges (a, u)
        large = now.join(least, now.b == least.u).select(now.a, F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(low, large.a == low.u).select(
            F.when(large.b == F.col("m"), large.a).otherwise(large.b).alias("a"), F.col("m").alias("b")
        )
        new = scratch.save(small.distinct(), "edges")
        scratch.drop(now)
        now, before, state = new, state, _state(new)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )

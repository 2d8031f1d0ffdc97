"""Connected components and reachability over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lingoscope.operators.storage import discard, stored

MAX_ROUNDS = 60
MAX_STEPS = 100_000  # of reachable without a depth: far above any crawl's, so that going on for ever is an error
CUT_STEPS = 20  # after so many the found nodes are stored again, which keeps plans short


def _lowest_neighbour(edges: DataFrame) -> DataFrame:
    """(u, m): each node and the smallest of it and its neighbours, from edges both ways."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Alternates two steps until nothing changes: every node hands its larger
    neighbours to its smallest one, then its smaller neighbours and itself.  The
    number of rounds grows with the logarithm of the largest component, edges
    never multiply, and no component is ever gathered in one task.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null").distinct()
    nodes = stored(e.select(F.col("u").alias("node")).union(e.select("v")).distinct())
    e = stored(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        both = e.union(e.select("v", "u"))
        large = both.join(_lowest_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, e = e, stored(small.where("u <> v").distinct())
        discard(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return nodes.join(e.withColumnRenamed("u", "node"), "node", "left").select("node", F.coalesce("v", "node").alias("component"))


def reachable(edges: DataFrame, start: DataFrame, src: str = "src", dst: str = "dst", max_depth: int | None = None) -> DataFrame:
    """(node, depth): nodes reached from the single-column ``start`` and in how few steps.

    Runs until no step finds anything new, unless a depth is asked for.
    """
    frontier = stored(start.toDF("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    seen = frontier
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("to"))
    for depth in range(1, (MAX_STEPS if max_depth is None else max_depth) + 1):
        reached = frontier.join(steps, "node").select(F.col("to").alias("node")).where("node is not null").distinct()
        frontier = stored(reached.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if depth % CUT_STEPS == 0:
            seen = stored(seen)
    else:
        if max_depth is None:
            raise RuntimeError(f"reachability did not end in {MAX_STEPS} steps")
    return seen

"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import scratch_dir


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``: root is the least node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014): each links a node's
    neighbours to the least of them. A node's least neighbour is a grouped minimum, combined before it is
    shuffled, so a node with very many neighbours is no single task's list. Each round is cut by a checkpoint
    in the shared folder. Raises if ``rounds`` do not suffice; the number grows with the logarithm of the nodes.
    """
    scratch_dir(edges.sparkSession)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    last = None
    for _ in range(rounds):
        # large star: each neighbour above a node is linked to the node's least neighbour (itself included)
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # small star: each neighbour at or below a node, and the node, are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = small.unionAll(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

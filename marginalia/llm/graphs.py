"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import release, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Each round joins every node's larger neighbours to its smallest neighbour, then its smaller ones (Kiveris et al.,
    Connected Components in MapReduce and Beyond); a round is two aggregations and is written to the shared folder.
    Null ends and loops are ignored. Nodes with many neighbours never form a list: minima are aggregated before the
    shuffle and the edges follow by a join. It ends when a round changes nothing; the number of rounds grows with the
    square of the logarithm of the nodes, and more than ``most_rounds`` are an error, never an incomplete result.
    """
    now = stored(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark, settled = None, False
    for _ in range(most_rounds):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        before, now = now, stored(small.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        release(before)
        if settled := state == mark:
            break
        mark = state
    if not settled:
        raise RuntimeError(f"components have not settled in {most_rounds} rounds")
    roots = now.groupBy("a").agg(F.min("b").alias("component"))
    return roots.select(F.col("a").alias("node"), "component").union(now.select("b", "b")).groupBy("node").agg(F.min("component").alias("component"))

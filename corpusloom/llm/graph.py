"""Connected components by alternating large and small stars, all in joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import forget, written


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """node, root (the least node of its component) for each node of ``edges`` (a long, b long).

    A round links every node's greater neighbours to its least neighbour, then
    every node's lesser neighbours; stars remain, after few rounds (of the order
    of the logarithm of the nodes: ``rounds`` raises, it never cuts short). Minima are
    combined before the shuffle and stored, so that the join that follows has
    nothing but edges on one side and Spark may split a node with very many.
    Tables of a round are removed once the next one is stored.
    """
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = None
    for i in range(rounds + 1):
        mark = now.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        if not mark["n"] or (mark["n"], mark["s"]) == state:
            break
        if i == rounds:
            raise RuntimeError(f"components: not finished after {rounds} rounds")
        state = (mark["n"], mark["s"])
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "cc-least")
        large = written(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "cc-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        then = written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "cc")
        forget(now, low, large, least)
        now = then
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

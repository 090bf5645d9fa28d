"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from surveyloom.operators.lookup import settle, settle_measured


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (the smallest node reachable) for all nodes of edges ``a``, ``b``.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its
    smaller ones, to the smallest node it knows. The graph shrinks to stars in a number of
    rounds that grows with the logarithm of its size. Each round is one aggregate and one join
    per step, so a node with very many edges is never gathered; rounds are written to shared
    storage. Self edges and repeated edges do no harm; an empty graph has no components.
    """
    pairs = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    every = settle(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    seen = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("b") % 1_000_003).alias("s")]
    # a is the larger node of an edge
    star = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    star, state = settle_measured(star, seen)
    while state["n"]:
        both = star.union(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = settle(large.filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b")))
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
        star, after = settle_measured(small, seen)
        if after == state:
            break
        state = after
    found = every.join(star.withColumnRenamed("a", "node"), "node", "left")
    return found.select("node", F.coalesce("b", "node").alias("component"))

"""Connected components of a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tables import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b``, where root is the smallest node of its component.

    Alternates two steps until nothing changes: each node's larger neighbours are hung on its smallest neighbour,
    then its smaller ones. Edges never multiply, a star's centre is aggregated before it is shuffled, and the
    number of rounds grows with the logarithm of the longest path. Loops (a = b) keep single nodes in the result.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    alone = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    # Each row points from a node to a smaller one.
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("up")).distinct()
    links, before = written(links, "links"), None
    while True:
        both = links.union(links.select("up", "node"))
        low = both.groupBy("node").agg(F.min("up").alias("low"))
        low = low.select("node", F.least("low", "node").alias("low"))
        large = both.where("up > node").join(low, "node").select(F.col("up").alias("node"), F.col("low").alias("up")).distinct()
        smallest = large.groupBy("node").agg(F.min("up").alias("low"))
        joined = large.join(smallest, "node")
        small = joined.select(F.col("up").alias("node"), F.col("low").alias("up")).where("node <> up")
        links = written(small.union(smallest).distinct(), "links")
        state = links.agg(F.count("*"), F.sum(F.xxhash64("node", "up").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return alone.join(links, "node", "left").groupBy("node").agg(F.min(F.coalesce("up", "node")).alias("root"))

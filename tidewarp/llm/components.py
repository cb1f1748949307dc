"""Connected components of an edge table, as joins and aggregates."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialized


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for each node of an edge the smallest node that it reaches. edges: two long columns.

    Alternates two steps until nothing changes: each node's larger neighbours move to its smallest
    neighbour, then each node's smaller neighbours do (large-star and small-star). Rows never outnumber
    the edges, the rounds grow with the logarithm of the longest chain, and each is written to the shared
    folder. A node with very many neighbours is a key of a minimum, summed in each task first, and of a
    join with those minima: a broadcast if they are few, else between two plain exchanges, which is split
    where skewed."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    now = materialized(now, "links")
    before = None
    while True:
        # larger neighbours of each node to the smallest of the node and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialized(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = now.select(F.col("v").alias("u"), F.col("u").alias("v")).join(broadcast_if_small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        # smaller neighbours of each node, and the node, to the smallest of them
        large = materialized(large, "large-star")
        least = materialized(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(broadcast_if_small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = materialized(small, "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

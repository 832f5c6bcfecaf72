"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storeyline.llm.common import written


def _with_least(rows: DataFrame) -> DataFrame:
    """Each row (u, v) with m, the least of u and its neighbours. The join goes by a hash of u, for which both sides
    are dealt anew: adaptive execution may then split the rows of a node with very many edges. It is a shuffled join
    at any size, so that the driver never holds a side."""
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    least = least.select(F.xxhash64("u").alias("k"), F.col("u").alias("lu"), "m")
    return rows.withColumn("k", F.xxhash64("u")).join(least.hint("shuffle_hash"), "k").where("u = lu").select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b).

    Alternates large-star and small-star steps until the edges are stars, which takes some logarithm
    of the largest component in rounds. Minima are combined before the shuffle. Each round is
    written to shared storage."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (found.n, found.s) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
        state = (found.n, found.s)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        now = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct())

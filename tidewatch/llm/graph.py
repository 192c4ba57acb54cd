"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.session import durable


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Of undirected edges (a, b) of longs: rows (c, root) for every vertex but the roots; root is the component's smallest.

    Alternates large and small stars: each vertex hangs its neighbours on the smallest vertex it knows. Every round is two
    combined aggregations and joins of narrow rows, with skewed vertices split by AQE; the driver sees a checksum only.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = durable(now), None
    for _ in range(most_rounds):
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("c"), F.col("v").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = durable(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
    raise RuntimeError("components did not settle")

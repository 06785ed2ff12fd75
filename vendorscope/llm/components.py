"""Connected components of an edge table by alternating large-star and
small-star steps (each an aggregate joined back, so a node with very many
edges is pre-aggregated and its join can be split). Every step is stored; the
loop ends when a round changes nothing. Nothing but two numbers per round
comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vendorscope.llm.common import stored


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the least of these."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(u, v) edges of longs -> (node, component): the least node reachable,
    for every node that is not the least itself. Nulls are dropped."""
    directed = (edges.filter("u is not null and v is not null and u <> v")
                .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    directed, before = stored(directed, name), None
    while True:
        seen = directed.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        now = (seen["n"], seen["x"])
        if now == before or not seen["n"]:
            return directed.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        directed = stored(small_star(large_star(directed)), name)

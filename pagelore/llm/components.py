"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``edges`` (u, v).

    Alternating large-star and small-star steps: every node hangs its larger neighbours,
    then itself and its smaller ones, on the smallest it knows. No neighbour list is ever
    gathered; each step is an aggregation and a join, and the number of rounds grows
    with the logarithm of the size. Each round is stored, and only two numbers per
    round come to the driver. Edges from a node to itself and null ends are ignored.
    """

    def hang(pairs: DataFrame, both: DataFrame) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return pairs.join(least, "u")

    current = materialize(
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hang(both, both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        hung = hang(large, large)
        small = (
            hung.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(hung.select("u", F.col("m").alias("v"))).distinct()
        )
        current = materialize(small, "small-star")
        now = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            break
        seen = now
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )

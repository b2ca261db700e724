"""Connected components of links that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.store import dropped, stored_at


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of ``links`` (a, b: numbers); the component is its smallest node.

    Alternating stars: every node's greater neighbours are hung on its smallest
    one, then every node and its smaller neighbours are hung on the smallest of
    those, until each component is a star. The rounds grow with the logarithm of
    a component's size. Each round is written to the shared folder, and the one
    before is deleted.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges, path = stored_at(edges, "links")
    state = None
    while True:
        row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == state:
            break
        state = (row["n"], row["s"])
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        hung = hung.join(least, "u")
        moved = hung.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(hung.select("u", F.col("m").alias("v")))
        old = path
        edges, path = stored_at(moved.distinct(), "links")
        dropped(links.sparkSession, old)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

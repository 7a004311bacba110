"""Connected components of links by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillstream.session import materialise


def _star(edges: DataFrame) -> DataFrame:
    """u, v, least: every directed edge with the smallest of u and its neighbours.

    The minimum is pre-aggregated, and the join is between written tables, so a node with very many
    links is split.
    """
    least = materialise(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least")), "least")
    return edges.join(least, "u")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) for all ids in ``links`` (a, b)."""
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = materialise(links, "links")
    state = None
    while True:
        both = materialise(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "links")
        # large star: larger neighbours go to the smallest neighbour
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        large = materialise(large.where("u != v").distinct(), "links")
        # small star: a node and its smaller neighbours go to the smallest of them
        small = _star(large)
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v")))
        edges = materialise(small.where("u != v").distinct(), "links")
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)

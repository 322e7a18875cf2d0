"""Connected components of a graph of links, by alternating large-star and small-star steps over stored tables.

Each step is a minimum per node and a join, both of which combine or split hot nodes; nothing is collected but one count
and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component) for the nodes of ``links`` (u, v) that are not the smallest of their component."""
    edges, before = stored(links.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "edges"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before or not now.n:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        before, old = now, edges
        edges = stored(_small_star(_large_star(edges)), "edges")
        forget(old)

"""Connected components by alternating large and small stars, as joins and pre-aggregated minima.

The minima are written before they are joined, so that both sides of the join come straight from their
exchanges and Spark can split a vertex that very many edges share. Each round's tables go when the next stand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._spark import drop, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with v < u. Large star: every larger neighbour is hung on the smallest one. Small
    star: every smaller neighbour, and the vertex itself. The result is written."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = written(near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
    hung = near.join(least, "u")
    if large:
        out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hung.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = written(out.where("u <> v").distinct(), "edges")
    drop(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of bigint vertices, in any order, loops and repeats allowed; returns (vertex,
    component) with the smallest vertex of each component, for all vertices but those smallest ones."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = None
    now = written(now, "edges")
    while True:
        hung = _star(now, True)
        drop(now)
        now = _star(hung, False)
        drop(hung)
        said = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(said) == state:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
        state = tuple(said)

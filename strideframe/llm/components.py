"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.llm.stored import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (a, b): the component is its smallest id.

    Every round hangs an id's larger neighbours, then its smaller ones, on the smallest of all; the number of
    rounds grows with the logarithm of the longest chain. Neighbours are joined back to their minimum, so a
    node with any number of links is spread over tasks by adaptive execution. Rows are null-free.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges, "edges")
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        edges = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = edges.where("u <> v").distinct()
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(lowest, "u")
        edges = near.select("u", F.col("m").alias("v")).union(near.where("v <> m").select("v", "m")).distinct()
        edges = stored(edges, "edges")
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(30,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )

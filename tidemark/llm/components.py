"""Connected components of an edge table by alternating star contraction.

Each round points every node's larger neighbours, then its smaller ones, at its smallest
neighbour, until nothing changes; then every edge leads to the smallest node of its component.
Only edges are kept, and each round is written to the shared folder, so neither the driver nor
one task ever holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shared import materialise


def _starred(pairs: DataFrame, lowest: DataFrame) -> DataFrame:
    """Edges from the second node of each pair to the smallest neighbour of the first."""
    return (
        pairs.join(lowest, "a")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .where("a > b")
    )


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of `edges(a, b)`; component is its smallest node.

    Nodes are long and not null. Self links and repeated edges are fine. An empty table gives
    an empty table.
    """
    edges = materialise(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    )
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = _starred(both.where("b > a"), lowest).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("low"))
        small = _starred(large, lowest).unionByName(lowest.withColumnRenamed("low", "b"))
        edges = materialise(small.distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state

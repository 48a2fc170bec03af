"""Set operations on symbol lists and snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_union(first: DataFrame, second: DataFrame, column: str = "symbol") -> DataFrame:
    """Distinct union that keeps the first appearance: `source` 0 before 1, then `ordinal`.

    Both sides carry the column and an `ordinal`.
    """
    both = first.select(column, "ordinal", F.lit(0).alias("source")).unionByName(
        second.select(column, "ordinal", F.lit(1).alias("source"))
    )
    return both.groupBy(column).agg(F.min(F.struct("source", "ordinal")).alias("__at")).select(
        column, "__at.source", "__at.ordinal"
    )


def added_since_previous(snapshots: DataFrame) -> DataFrame:
    """Members each snapshot has that the previous snapshot lacked.

    The previous date is looked up in the list of snapshot dates (one row per snapshot).
    """
    dates = snapshots.select("effective_from").distinct()
    ordered = Window.partitionBy(F.lit(1)).orderBy("effective_from")
    previous = dates.withColumn("__previous", F.lag("effective_from").over(ordered))
    before = snapshots.select(F.col("effective_from").alias("__previous"), "security_id")
    return (
        snapshots.join(previous, "effective_from")
        .join(before, ["__previous", "security_id"], "left_anti")
        .drop("__previous")
    )


def overlap(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows both sides share; must be empty for benchmarks against a universe."""
    return left.select(*columns).intersect(right.select(*columns))


def set_difference(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-way difference with the side each row is missing from."""
    a, b = left.select(*columns).distinct(), right.select(*columns).distinct()
    return (
        a.join(b, list(columns), "left_anti")
        .withColumn("missing_from", F.lit("right"))
        .unionByName(
            b.join(a, list(columns), "left_anti").withColumn("missing_from", F.lit("left"))
        )
    )


def universe_check(symbols: DataFrame, benchmarks: DataFrame, target: int) -> DataFrame:
    """One row: size against target, duplicates, and benchmark overlap."""
    counts = symbols.agg(
        F.count("*").alias("rows"), F.count_distinct("symbol").alias("distinct_symbols")
    ).withColumn("__one", F.lit(1))
    shared = (
        symbols.join(benchmarks.select("symbol").distinct(), "symbol", "left_semi")
        .agg(F.count("*").alias("benchmark_overlap"))
        .withColumn("__one", F.lit(1))
    )
    return (
        counts.join(shared, "__one")
        .drop("__one")
        .withColumn(
            "valid",
            (F.col("rows") == target)
            & (F.col("rows") == F.col("distinct_symbols"))
            & (F.col("benchmark_overlap") == 0),
        )
    )

"""Exact ranks and medians over groups of any size.

A group is a series in the order of its values (`segments`): groups with few rows are ranked whole,
those with very many are cut where counts of their values say, ranked piece by piece, and a carry of
one small row per piece makes the ranks exact. Nothing is sampled, nothing is written on the way and
no size decides how it is done.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import SEGMENT_ROWS, KeyedSeries, Segmentation

#: Bits of a value that take part in cutting groups, and how many values of it make a counted cell.
MANTISSA_BITS = 20
CELL = 1 << 8
_ALONG = "__along"


def rising(value: Column) -> Column:
    """A long that never falls as a double rises: its exponent and the first bits of its mantissa.

    Where log2 rounds to a neighbouring exponent the mantissa leaves its range by as much, so the
    sum is the same. Null counts below all values, NaN above them.
    """
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log2(size))
    bits = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * (1 << MANTISSA_BITS))
    key = (exponent + 1_100) * (1 << MANTISSA_BITS) + bits
    top = 1 << 40
    return (
        F.when(value.isNull(), F.lit(-top - 1))
        .when(F.isnan(value.cast("double")), F.lit(top + 1))
        .when(size == 0, F.lit(0))
        .when(size == float("inf"), F.signum(value.cast("double")) * top)
        .otherwise(F.signum(value.cast("double")) * key)
        .cast("long")
    )


def rising_text(value: Column, characters: int = 10) -> Column:
    """A long that never falls as a text rises; it tells dates in ISO form apart.

    Digits and the signs `-./` are told apart in the first characters; what follows any other
    character does not count. Null counts below all texts.
    """
    code = lambda i: F.ascii(F.substring(value, i, 1))
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(True).alias("on"))

    def step(so_far: Column, i: Column) -> Column:
        known = so_far["on"] & code(i).between(45, 57)
        place = F.when(known, code(i) - 44).when(so_far["on"] & (code(i) > 57), 15).otherwise(0)
        return F.struct((so_far["sum"] * 16 + place).alias("sum"), known.alias("on"))

    places = F.sequence(F.lit(1), F.lit(characters))
    return F.when(value.isNull(), F.lit(-1).cast("long")).otherwise(F.aggregate(places, start, step)["sum"])


def _series(
    df: DataFrame, group: Sequence[str], along: Column, order: Sequence[Column], rows: int
) -> KeyedSeries:
    """`df` as series of `group`, cut along the long `along`, in the order of all columns given."""
    frame = df.withColumn(_ALONG, along)
    cuts = Segmentation.for_input(frame, group, F.col(_ALONG), cell=CELL, rows=rows)
    return KeyedSeries(frame, group, [_ALONG, *order], cuts)


def position(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    *,
    along: Column,
    name: str = "position",
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """1-based position of every row in its group under a total order.

    `along` is a long that never falls in this order, such as `rising` of the first column, or its
    negative where that descends. Rows that are equal in it stay together.
    """
    series = _series(df, group, along, order, rows)
    series.accumulate(sums={name: F.lit(1).cast("long")})
    return series.finish().withColumn(name, F.col(name).cast("int")).drop(_ALONG)


def weighted_prefix(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    weight: Column,
    *,
    along: Column,
    name: str,
    rows: int = SEGMENT_ROWS,
) -> DataFrame:
    """Running sum of `weight` up to and including each row of its group."""
    series = _series(df, group, along, order, rows)
    series.accumulate(sums={name: weight})
    return series.finish().drop(_ALONG)


def group_median(
    df: DataFrame, group: Sequence[str], value: Column, *, name: str = "median", rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Exact median per group: count equal values first, then find the middle ones.

    `group` must name at least one column; use a constant column for a global median.
    """
    counts = (
        df.select(*group, value.cast("double").alias("__v"))
        .filter(F.col("__v").isNotNull())
        .groupBy(*group, "__v")
        .agg(F.count("*").alias("__n"))
    )
    series = _series(counts, group, rising(F.col("__v")), [F.col("__v").asc()], rows)
    series.accumulate(sums={"__upto": F.col("__n")}, key_sums={"__total": F.col("__n")})
    low = F.floor((F.col("__total") + 1) / 2)
    high = F.floor((F.col("__total") + 2) / 2)
    after = F.col("__upto")
    before = F.col("__upto") - F.col("__n")
    middle = (before < low) & (low <= after), (before < high) & (high <= after)
    return (
        series.finish()
        .filter(middle[0] | middle[1])
        .groupBy(*group)
        .agg(((F.max(F.when(middle[0], F.col("__v"))) + F.max(F.when(middle[1], F.col("__v")))) / 2).alias(name))
    )


def dense_position(
    df: DataFrame, group: Sequence[str], value: str, *, rows: int = SEGMENT_ROWS
) -> DataFrame:
    """Distinct values per group with their 0-based rank and the number of distinct values."""
    distinct = df.select(*group, value).filter(F.col(value).isNotNull()).distinct()
    series = _series(distinct, group, rising(F.col(value)), [F.col(value).asc()], rows)
    one = F.lit(1).cast("long")
    series.accumulate(sums={"__r": one}, key_sums={"distinct_values": one})
    rank = (F.col("__r") - 1).cast("int").alias("dense_rank")
    return series.finish().select(*group, value, rank, "distinct_values")

"""Ticks to bars, bars to coarser bars, and bar comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.segments import KeyedSeries, Segmentation

MICROS_PER_MINUTE = 60_000_000


def _day_bin(at: Column, minutes: int) -> Column:
    """Left edge of an n-minute bin counted from midnight UTC of the row's own day."""
    micros = F.unix_micros(at)
    midnight = F.floor(micros / (1440 * MICROS_PER_MINUTE)) * (1440 * MICROS_PER_MINUTE)
    width = minutes * MICROS_PER_MINUTE
    return F.timestamp_micros((midnight + F.floor((micros - midnight) / width) * width).cast("long"))


def volume_delta(volume: Column, previous: Column) -> Column:
    """Traded volume from a cumulative counter; a reset starts again from its new value."""
    value = volume.cast("double")
    return F.when(previous.isNull() | (value < previous), value).otherwise(value - previous)


def with_volume_delta(
    samples: DataFrame,
    *,
    keys: Sequence[str] = ("symbol", "session_date"),
    segmentation: Segmentation | None = None,
    name: str = "volume_delta",
) -> DataFrame:
    segmentation = segmentation or Segmentation.for_input(
        samples, keys, F.unix_micros("received_at")
    )
    series = KeyedSeries(
        samples.withColumn("__us", F.unix_micros("received_at")),
        keys,
        ["__us"],
        segmentation,
        halo=1,
    )
    previous = F.lag(F.col("volume").cast("double")).over(series.local)
    series.with_columns({name: volume_delta(F.col("volume"), previous)})
    return series.finish().drop("__us")


def resample(
    samples: DataFrame,
    minutes: int,
    *,
    volume_is_delta: bool = False,
    segmentation: Segmentation | None = None,
) -> DataFrame:
    """OHLCV bars per (symbol, session), left-closed and left-labelled; empty bins absent.

    The aggregation combines on the map side, so only one row per bin and task is shuffled
    again after the counter has been turned into traded volume.
    """
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    frame = (
        samples.withColumn("volume_delta", F.col("volume").cast("double"))
        if volume_is_delta
        else with_volume_delta(samples, segmentation=segmentation)
    )
    at = F.col("received_at")
    price = F.col("last_trade_price")
    return (
        frame.groupBy("symbol", "session_date", _day_bin(at, minutes).alias("start"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            F.sum("volume_delta").alias("volume"),
        )
        .withColumn("end", F.col("start") + F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    )


def rollup(bars: DataFrame, minutes: int) -> DataFrame:
    """Bars to coarser bars per (symbol, session)."""
    if minutes <= 0:
        raise ValueError("minutes must be positive")
    start = F.col("start")
    return (
        bars.groupBy("symbol", "session_date", _day_bin(start, minutes).alias("__bin"))
        .agg(
            F.min_by("open", start).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", start).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .withColumnRenamed("__bin", "start")
        .withColumn("end", F.col("start") + F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    )


def bar_problem(df: DataFrame) -> Column:
    """First broken OHLCV rule of a bar, null when the bar is valid."""
    o, h, low, c = (F.col(name) for name in ("open", "high", "low", "close"))
    return (
        F.when(
            o.isNull() | h.isNull() | low.isNull() | c.isNull() | F.col("volume").isNull(),
            "incomplete bar",
        )
        .when(F.isnan(o) | F.isnan(h) | F.isnan(low) | F.isnan(c), "non-finite price")
        .when(F.least(o, h, low, c) <= 0, "non-positive price")
        .when(h < F.greatest(o, c, low), "high below open/close/low")
        .when(low > F.least(o, c), "low above open/close")
        .when(F.col("volume") < 0, "negative volume")
        .when(F.col("end") <= F.col("start"), "end not after start")
    )


def order_problems(bars: DataFrame, keys: Sequence[str] = ("symbol", "session_date")) -> DataFrame:
    """Keys that repeat a bar start; replay needs strictly increasing starts."""
    return (
        bars.groupBy(*keys, "start")
        .agg(F.count("*").alias("__n"))
        .groupBy(*keys)
        .agg(
            F.sum("__n").alias("rows"),
            F.count("*").alias("distinct_starts"),
            F.max("__n").alias("max_repeats"),
        )
        .filter(F.col("rows") != F.col("distinct_starts"))
    )


def compare_bars(
    actual: DataFrame,
    expected: DataFrame,
    *,
    keys: Sequence[str] = ("symbol", "session_date"),
    price_tolerance: float = 1e-9,
) -> DataFrame:
    """Row-aligned comparison per key; one row per difference.

    A key whose row counts differ gives a single row-count difference. Rows are aligned by
    their position in start order; bars are unique per start, so a key holds at most one
    row per minute of its session.
    """
    if price_tolerance < 0:
        raise ValueError("price tolerance must be non-negative")
    w = Window.partitionBy(*keys).orderBy("start")
    fields = ["start", "end", "open", "high", "low", "close", "volume"]

    def aligned(frame: DataFrame, side: str) -> DataFrame:
        whole = Window.partitionBy(*keys)
        return frame.select(
            *keys,
            (F.row_number().over(w) - 1).alias("row"),
            F.count("*").over(whole).alias(f"{side}_rows"),
            F.struct(*fields).alias(side),
        )

    joined = aligned(actual, "actual").join(
        aligned(expected, "expected"), [*keys, "row"], "full_outer"
    )
    per_key = Window.partitionBy(*keys)
    rows_actual = F.coalesce(F.max("actual_rows").over(per_key), F.lit(0))
    rows_expected = F.coalesce(F.max("expected_rows").over(per_key), F.lit(0))
    counted = joined.withColumns({"__a": rows_actual, "__e": rows_expected})
    same_count = F.col("__a") == F.col("__e")
    same_start = F.col("actual.start") == F.col("expected.start")
    findings = [
        F.when(~same_count & (F.col("row") == 0), F.lit("row count differs")),
        F.when(same_count & ~same_start, F.lit("start differs")),
        F.when(
            same_count & same_start & (F.col("actual.end") != F.col("expected.end")),
            F.lit("end differs"),
        ),
        *[
            F.when(
                same_count
                & same_start
                & (F.abs(F.col(f"actual.{name}") - F.col(f"expected.{name}")) > price_tolerance),
                F.lit(f"{name} differs"),
            )
            for name in ("open", "high", "low", "close")
        ],
        F.when(
            same_count
            & same_start
            & (F.col("actual.volume").cast("long") != F.col("expected.volume").cast("long")),
            F.lit("volume differs"),
        ),
    ]
    return counted.select(
        *keys, "row", F.explode(F.array_compact(F.array(*findings))).alias("difference")
    )

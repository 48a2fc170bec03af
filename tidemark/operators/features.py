"""Point-in-time market features per (symbol, session)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import EXCHANGE_ZONE, second_of_day
from tidemark.functions.numbers import is_finite, positive
from tidemark.operators.asof import asof_join
from tidemark.operators.bars import volume_delta
from tidemark.operators.segments import KeyedSeries, Segmentation
from tidemark.policies import FeatureWindows

# Fixed values ------------------------------------------------------------------------
FEATURE_VERSION = "m4-pr3-v1"
# -------------------------------------------------------------------------------------

KEYS = ["symbol", "session_date"]


def market_time(df: DataFrame) -> Column:
    """Observation time: the source's own time when known, else the receipt time."""
    if "source_at" in df.columns:
        return F.coalesce(F.col("source_at"), F.col("received_at"))
    return F.col("received_at")


def observation_problem(df: DataFrame) -> Column:
    """First broken rule of an eligible observation, null when usable.

    Duplicate times need a look at other rows; see `duplicate_observations`.
    """
    price, bid, ask, volume = (
        F.col(name) for name in ("last_trade_price", "bid_price", "ask_price", "volume")
    )
    return (
        F.when(F.col("received_at").isNull(), "missing time")
        .when(
            ~(is_finite(price) & is_finite(bid) & is_finite(ask) & is_finite(volume)),
            "incomplete level 1 values",
        )
        .when(F.least(price, bid, ask) <= 0, "non-positive price")
        .when(volume < 0, "negative volume")
        .when(ask < bid, "crossed market")
    )


def duplicate_observations(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "received_at").agg(F.count("*").alias("rows")).filter("rows > 1")


def prepare_observations(df: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Rows known by the cutoff and eligible; broken rows are dropped (quarantine them with
    `observation_problem`). Rows that repeat a symbol's time are a fault of the source
    (`duplicate_observations` lists them); the largest of them by price and then by the other
    columns stands, so that results never depend on the order of reading."""
    frame = df if as_of is None else df.filter(F.col("received_at") <= as_of)
    if "is_trade_eligible" in frame.columns:
        frame = frame.filter(F.col("is_trade_eligible"))
    return frame.filter(observation_problem(frame).isNull())


def one_per_time(frame: DataFrame) -> DataFrame:
    """One row for each time of a key, by the rule of `prepare_observations`."""
    rest = [name for name in frame.columns if name not in (*KEYS, "received_at", "last_trade_price")]
    top = F.max(F.struct("last_trade_price", *rest)).alias("__top")
    return frame.groupBy(*KEYS, "received_at").agg(top).select(*KEYS, "received_at", "__top.*")


def _in_opening_range(at: Column, minutes: int) -> Column:
    second = second_of_day(F.from_utc_timestamp(at, EXCHANGE_ZONE))
    start = 9 * 3600 + 30 * 60
    return (second >= start) & (second < start + minutes * 60)


def opening_range_check(df: DataFrame, minutes: int = 5) -> DataFrame:
    """Per key: is there exactly one observation in every opening minute?

    `complete` is the strict rule; `covered` the live rule (every minute seen and the last
    observation at or after the end of the range).
    """
    at = market_time(df)
    local = F.from_utc_timestamp(at, EXCHANGE_ZONE)
    inside = _in_opening_range(at, minutes)
    minute = F.when(inside, F.minute(local))
    second = second_of_day(local)
    end = 9 * 3600 + 30 * 60 + minutes * 60
    return (
        df.groupBy(*KEYS)
        .agg(
            F.count_if(inside).alias("opening_rows"),
            F.count_distinct(minute).alias("opening_minutes"),
            F.max(second).alias("__last"),
        )
        .select(
            *KEYS,
            "opening_rows",
            "opening_minutes",
            (
                (F.col("opening_rows") == minutes) & (F.col("opening_minutes") == minutes)
            ).alias("complete"),
            ((F.col("opening_minutes") == minutes) & (F.col("__last") >= end)).alias("covered"),
        )
    )


def _relative_strength(
    frame: DataFrame,
    benchmark: DataFrame,
    name: str,
    segmentation: Segmentation,
    asof_cut: Segmentation | None,
) -> DataFrame:
    """Own return since the first row minus the as-of benchmark return since then."""
    lookup = benchmark.select(
        "session_date",
        F.col("received_at").alias("__b_at"),
        F.col("last_trade_price").cast("double").alias("__b_price"),
    )
    joined = asof_join(
        frame,
        lookup,
        by=["session_date"],
        left_time="received_at",
        right_time="__b_at",
        values=["__b_price"],
        segmentation=asof_cut,
    )
    series = KeyedSeries(joined, KEYS, ["__us"], segmentation)
    series.accumulate(
        firsts={
            "__first_price": F.col("last_trade_price").cast("double"),
            "__first_b": F.col("__b_price"),
        }
    )
    own = F.col("last_trade_price") / F.col("__first_price") - 1
    other = F.col("__b_price") / F.col("__first_b") - 1
    return (
        series.finish()
        .withColumn(name, F.when(F.col("__first_b").isNotNull(), own - other))
        .drop("__b_at", "__b_price", "__first_price", "__first_b")
    )


def market_features(
    samples: DataFrame,
    *,
    as_of: Column | None = None,
    windows: FeatureWindows | None = None,
    previous_close: Column | None = None,
    market: DataFrame | None = None,
    sector: DataFrame | None = None,
    volume_is_delta: bool = False,
    running_opening_range: bool = False,
    segmentation: Segmentation | None = None,
) -> DataFrame:
    """All per-observation features.

    Every window is partitioned by (symbol, session[, segment]), so apart from the two
    benchmark joins the data is shuffled once. With `running_opening_range` each row only
    sees the opening range up to itself (point-in-time replay of every prefix).
    """
    windows = windows or FeatureWindows()
    # The as-of joins have the session as key. Raw rows are counted for them, not derived ones.
    asof_cut = segmentation if segmentation and segmentation.minutes else None
    if asof_cut is None and (market is not None or sector is not None):
        sides = [side.select("session_date", "received_at") for side in (samples, market, sector) if side is not None]
        asof_cut = Segmentation.for_input(reduce(DataFrame.unionByName, sides), ["session_date"], F.unix_micros("received_at"))
    segmentation = segmentation or Segmentation.for_input(
        samples, KEYS, F.unix_micros("received_at")
    )
    frame = prepare_observations(samples, as_of)
    at = market_time(frame)
    inside = _in_opening_range(at, windows.opening_range_minutes)
    high = F.col("high_price") if "high_price" in frame.columns else F.col("last_trade_price")
    low = F.col("low_price") if "low_price" in frame.columns else F.col("last_trade_price")
    price = F.col("last_trade_price").cast("double")
    series = KeyedSeries(
        frame.withColumns(
            {
                "__us": F.unix_micros("received_at"),
                "__or_high": F.when(inside, high.cast("double")),
                "__or_low": F.when(inside, low.cast("double")),
            }
        ),
        KEYS,
        ["__us"],
        segmentation,
        halo=max(windows.rvol_window, windows.volatility_window) + 1,
    )
    local = series.local
    delta = (
        F.col("volume").cast("double")
        if volume_is_delta
        else volume_delta(F.col("volume"), F.lag(F.col("volume").cast("double")).over(local))
    )
    series.with_columns(
        {"volume_delta": delta, "__return": price / F.lag(price).over(local) - 1}
    )
    prior = F.avg("volume_delta").over(series.trailing(-windows.rvol_window, -1))
    recent = series.trailing(-(windows.volatility_window - 1), 0)
    series.with_columns({"__prior": prior})
    series.with_columns(
        {
            "volume_acceleration": F.col("volume_delta") / positive(F.col("__prior")),
            "volatility": F.when(
                F.count("__return").over(recent) == windows.volatility_window,
                F.stddev_pop("__return").over(recent),
            ),
        }
    )
    opening = {"opening_range_high": F.col("__or_high")}, {"opening_range_low": F.col("__or_low")}
    series.accumulate(
        sums={"__pv": price * F.col("volume_delta"), "cumulative_volume": F.col("volume_delta")},
        firsts={"__first": price},
        maxima=opening[0] if running_opening_range else None,
        minima=opening[1] if running_opening_range else None,
        key_maxima=None if running_opening_range else opening[0],
        key_minima=None if running_opening_range else opening[1],
        emas={"ema": (price, windows.ema_span)},
    )
    out = series.finish()

    midpoint = (F.col("ask_price") + F.col("bid_price")) / 2
    columns = {
        "vwap": F.col("__pv") / positive(F.col("cumulative_volume")),
        "gap_pct": (
            F.lit(None).cast("double")
            if previous_close is None
            else F.col("__first") / positive(previous_close) - 1
        ),
        "rvol": (
            F.col("cumulative_volume")
            / positive(F.col("expected_cumulative_volume").cast("double"))
            if "expected_cumulative_volume" in out.columns
            else F.col("volume_acceleration")
        ),
        "spread_pct": (F.col("ask_price") - F.col("bid_price")) / positive(midpoint),
        "feature_version": F.lit(FEATURE_VERSION),
        "data_cutoff": F.col("received_at") if as_of is None else as_of,
    }
    out = out.withColumns(columns)
    for name, benchmark in (
        ("market_relative_strength", market),
        ("sector_relative_strength", sector),
    ):
        if benchmark is None:
            out = out.withColumn(name, F.lit(None).cast("double"))
        else:
            out = _relative_strength(
                out, prepare_observations(benchmark, as_of), name, segmentation, asof_cut
            )
    return out.drop("__us", "__or_high", "__or_low", "__return", "__prior", "__pv", "__first")


def minute_bar_features(bars: DataFrame, **options: object) -> DataFrame:
    """Features from minute bars: bid and ask equal the close, so the spread is zero."""
    samples = bars.withColumns(
        {
            "received_at": F.col("start"),
            "last_trade_price": F.col("close"),
            "bid_price": F.col("close"),
            "ask_price": F.col("close"),
            "high_price": F.col("high"),
            "low_price": F.col("low"),
        }
    )
    return market_features(samples, volume_is_delta=True, **options)

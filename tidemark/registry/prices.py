"""Price-series queries: bars, features, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as bar_ops
from tidemark.operators import features as feature_ops
from tidemark.operators.segments import KeyedSeries, Segmentation
from tidemark.policies import FeatureWindows
from tidemark.registry.core import query
from tidemark.registry.views import bars, day_text, quotes_dense, us


def bar_columns() -> list:
    return [
        "symbol",
        day_text("session_date").alias("session"),
        us("start").alias("start_us"),
        *[F.round(name, 6).alias(name) for name in ("open", "high", "low", "close")],
        F.col("volume").cast("long").alias("volume"),
    ]


BAR_SQL = """
SELECT symbol, session, start_us, round(open, 6) AS open, round(high, 6) AS high,
       round(low, 6) AS low, round(close, 6) AS close, CAST(volume AS BIGINT) AS volume
FROM {source}
"""


@query("ohlcv_bars", BAR_SQL.format(source="bars"), "bars")
def ohlcv_bars(spark: SparkSession, folder: str) -> DataFrame:
    return bars(spark, folder).select(*bar_columns())


@query(
    "bars_rollup",
    BAR_SQL.format(
        source="""(SELECT symbol, session, start_us // 14400000000 * 14400000000 AS start_us,
       arg_min(open, start_us) AS open, max(high) AS high, min(low) AS low,
       arg_max(close, start_us) AS close, sum(volume) AS volume
     FROM bars GROUP BY symbol, session, 3)"""
    ),
    "bars",
)
def bars_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return bar_ops.rollup(bars(spark, folder), 240).select(*bar_columns())


@query(
    "bars_compare",
    """
WITH rolled AS (
  SELECT symbol, session, start_us // 14400000000 * 14400000000 AS s,
         arg_min(open, start_us) AS open, max(high) AS high, min(low) AS low,
         arg_max(close, start_us) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM bars GROUP BY symbol, session, 3),
direct AS (
  SELECT symbol, session, received_us // 14400000000 * 14400000000 AS s,
         arg_min(price, received_us) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, received_us) + CASE WHEN day(min(ts)) % 7 = 0 THEN 0.5 ELSE 0 END AS close,
         CAST(sum(volume) AS BIGINT) AS volume
  FROM quotes_dense GROUP BY symbol, session, 3),
paired AS (
  SELECT symbol, session,
         row_number() OVER (PARTITION BY symbol, session ORDER BY s) - 1 AS row,
         rolled.close AS ac, direct.close AS ec, rolled.volume AS av, direct.volume AS ev
  FROM rolled JOIN direct USING (symbol, session, s))
SELECT symbol, session, row, 'close differs' AS difference FROM paired WHERE abs(ac - ec) > 1e-9
UNION ALL
SELECT symbol, session, row, 'volume differs' FROM paired WHERE av <> ev
""",
    "bars",
    "quotes_dense",
)
def bars_compare(spark: SparkSession, folder: str) -> DataFrame:
    """Bars rolled up from hourly bars against four-hour bars of altered raw ticks."""
    rolled = bar_ops.rollup(bars(spark, folder), 240)
    direct = bar_ops.resample(
        quotes_dense(spark, folder), 240, volume_is_delta=True
    ).withColumn(
        "close",
        F.col("close") + F.when(F.dayofmonth("session_date") % 7 == 0, 0.5).otherwise(0.0),
    )
    return bar_ops.compare_bars(rolled, direct).select(
        "symbol", day_text("session_date").alias("session"), "row", "difference"
    )


def _features(spark: SparkSession, folder: str, **options: object) -> DataFrame:
    return feature_ops.market_features(quotes_dense(spark, folder), **options)


def key_columns() -> list:
    return ["event_id", "symbol", us("received_at").alias("received_us")]



@query(
    "volume_delta_vwap",
    """
SELECT event_id, symbol, received_us, CAST(volume_delta AS BIGINT) AS volume_delta,
       round(sum(price * volume_delta) OVER w
             / nullif(sum(volume_delta) OVER w, 0), 6) AS vwap
FROM deltas
WINDOW w AS (PARTITION BY symbol, session ORDER BY received_us ROWS UNBOUNDED PRECEDING)
""",
    "deltas",
)
def volume_delta_vwap(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).select(
        *key_columns(),
        F.col("volume_delta").cast("long").alias("volume_delta"),
        F.round("vwap", 6).alias("vwap"),
    )


@query(
    "ema9",
    """
WITH RECURSIVE numbered AS (
  SELECT event_id, symbol, session, received_us, price,
         row_number() OVER (PARTITION BY symbol, session ORDER BY received_us) AS i
  FROM quotes_dense),
walk AS (
  SELECT event_id, symbol, session, received_us, i, price AS ema FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.event_id, n.symbol, n.session, n.received_us, n.i, 0.8 * w.ema + 0.2 * n.price
  FROM walk w JOIN numbered n ON n.symbol = w.symbol AND n.session = w.session AND n.i = w.i + 1)
SELECT event_id, symbol, received_us, round(ema, 6) AS ema FROM walk
""",
    "quotes_dense",
)
def ema9(spark: SparkSession, folder: str) -> DataFrame:
    df = quotes_dense(spark, folder).withColumn("__us", F.unix_micros("received_at"))
    series = KeyedSeries(df, feature_ops.KEYS, ["__us"], Segmentation.for_input(df, feature_ops.KEYS, F.col("__us")))
    series.ema("ema", F.col("last_trade_price"), FeatureWindows().ema_span)
    return series.finish().select(*key_columns(), F.round("ema", 6).alias("ema"))


@query(
    "opening_range",
    """
WITH opening AS (
  SELECT symbol, session, max(price) AS hi, min(price) AS lo FROM (
    SELECT symbol, session, price,
           timezone('America/New_York', timezone('UTC', make_timestamp(source_us))) AS et
    FROM quotes_dense)
  WHERE hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 600
  GROUP BY ALL)
SELECT q.event_id, q.symbol, q.received_us, round(hi, 6) AS opening_range_high,
       round(lo, 6) AS opening_range_low
FROM quotes_dense q LEFT JOIN opening o ON q.symbol = o.symbol AND q.session = o.session
""",
    "quotes_dense",
)
def opening_range(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder, windows=FeatureWindows(opening_range_minutes=30)).select(
        *key_columns(),
        F.round("opening_range_high", 6).alias("opening_range_high"),
        F.round("opening_range_low", 6).alias("opening_range_low"),
    )


@query(
    "gap_pct",
    """
SELECT event_id, symbol, received_us,
       round(first_value(price) OVER (PARTITION BY symbol, session ORDER BY received_us)
             / (99.5::DOUBLE + CAST(day(ts) AS INTEGER) / 10.0::DOUBLE) - 1, 8) AS gap_pct
FROM quotes_dense
""",
    "quotes_dense",
)
def gap_pct(spark: SparkSession, folder: str) -> DataFrame:
    previous_close = F.lit(99.5) + F.dayofmonth("session_date") / F.lit(10.0)
    return _features(spark, folder, previous_close=previous_close).select(
        *key_columns(), F.round("gap_pct", 8).alias("gap_pct")
    )


@query(
    "rvol_accel",
    """
SELECT event_id, symbol, received_us, round(volume_delta / nullif(prior, 0), 6) AS rvol,
       round(volume_delta / nullif(prior, 0), 6) AS volume_acceleration
FROM (SELECT *, avg(volume_delta) OVER (PARTITION BY symbol, session ORDER BY received_us
                                        ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prior
      FROM deltas)
""",
    "deltas",
)
def rvol_accel(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).select(
        *key_columns(),
        F.round("rvol", 6).alias("rvol"),
        F.round("volume_acceleration", 6).alias("volume_acceleration"),
    )


@query(
    "rvol_expected",
    """
SELECT event_id, symbol, received_us,
       round(sum(volume_delta) OVER (PARTITION BY symbol, session ORDER BY received_us
                                     ROWS UNBOUNDED PRECEDING)
             / nullif((event_id % 4) * 1000.0::DOUBLE, 0), 6) AS rvol
FROM deltas
""",
    "deltas",
)
def rvol_expected(spark: SparkSession, folder: str) -> DataFrame:
    """Relative volume against a supplied expectation instead of the trailing mean."""
    samples = quotes_dense(spark, folder).withColumn(
        "expected_cumulative_volume", (F.col("event_id") % 4) * 1000.0
    )
    return feature_ops.market_features(samples).select(
        *key_columns(), F.round("rvol", 6).alias("rvol")
    )


@query(
    "rolling_volatility",
    """
SELECT event_id, symbol, received_us,
       round(CASE WHEN count(ret) OVER w = 5 THEN stddev_pop(ret) OVER w END, 8) AS volatility
FROM (SELECT *, price / lag(price) OVER (PARTITION BY symbol, session ORDER BY received_us) - 1
              AS ret FROM quotes_dense)
WINDOW w AS (PARTITION BY symbol, session ORDER BY received_us
             ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)
""",
    "quotes_dense",
)
def rolling_volatility(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).select(
        *key_columns(), F.round("volatility", 8).alias("volatility")
    )


@query(
    "spread_pct",
    """
SELECT event_id, symbol, received_us,
       round((ask - bid) / ((ask + bid) / 2), 8) AS spread_pct
FROM quotes_dense
""",
    "quotes_dense",
)
def spread_pct(spark: SparkSession, folder: str) -> DataFrame:
    return _features(spark, folder).select(
        *key_columns(), F.round("spread_pct", 8).alias("spread_pct")
    )

"""Market-shaped views over the driver tables, as DataFrames and as SQL text.

Every view is a row-wise function of its inputs, so the work stays in the operators.
Times are microseconds since the epoch in results, which compare the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.registry.core import sql_view, table


def micros(column: str) -> Column:
    """Microseconds of a zone-less timestamp, independent of the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


def us(column: str) -> Column:
    return F.unix_micros(F.col(column))


def day_text(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd")


# ---- quotes -------------------------------------------------------------------------

sql_view(
    "ticks",
    """
    SELECT event_id, user_id, event_type, value, ts,
           CAST(epoch_us(ts) AS BIGINT) AS received_us,
           strftime(ts, '%Y-%m-%d') AS session,
           100 + value / 10 AS price,
           CAST(((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) % 43200) * 7 AS BIGINT)
             + CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS BIGINT) AS volume
    FROM events
    """,
)
sql_view(
    "quotes_dense",
    """
    SELECT *, event_type AS symbol,
           price * (1 - (1 + event_id % 5) / 1000.0::DOUBLE) AS bid,
           price * (1 + (1 + event_id % 5) / 1000.0::DOUBLE) AS ask,
           received_us - (event_id % 7) * 1000000 AS source_us
    FROM ticks
    """,
    "ticks",
)


def ticks(events: DataFrame) -> DataFrame:
    received = micros("ts")
    second = F.floor(F.pmod(received, F.lit(43_200_000_000)) / 1_000_000)
    return events.select(
        "event_id",
        "user_id",
        "event_type",
        F.timestamp_micros(received).alias("received_at"),
        F.to_date(F.timestamp_micros(received)).alias("session_date"),
        (100 + F.col("value") / 10).alias("last_trade_price"),
        (
            (second * 7).cast("long")
            + F.regexp_extract("props", '"k": ?([0-9]+)', 1).cast("long")
        ).alias("volume"),
    )


def _sides(df: DataFrame) -> DataFrame:
    spread = (1 + F.col("event_id") % 5) / F.lit(1000.0)
    return df.withColumns(
        {
            "bid_price": F.col("last_trade_price") * (1 - spread),
            "ask_price": F.col("last_trade_price") * (1 + spread),
            "source_at": F.timestamp_micros(
                F.unix_micros("received_at") - (F.col("event_id") % 7) * 1_000_000
            ),
        }
    )


def quotes_dense(spark: SparkSession, folder: str) -> DataFrame:
    """Five busy symbols, one per event type."""
    return dense_from_events(table(spark, folder, "events"))


def dense_from_events(events: DataFrame) -> DataFrame:
    return _sides(ticks(events)).withColumn("symbol", F.col("event_type"))


sql_view(
    "quotes",
    """
    SELECT 'U' || user_id AS symbol, user_id AS symbol_id, event_id, ts, received_us, session,
           price AS last_trade_price, volume,
           CASE WHEN event_id % 101 = 0 THEN NULL
                WHEN event_id % 103 = 0 THEN ask * 1.01
                WHEN event_id % 107 = 0 THEN 0.0
                ELSE bid END AS bid,
           ask, source_us,
           event_type = 'error' AS is_halted,
           CASE WHEN event_id % 97 = 0 THEN 15 ELSE 0 END AS delay_seconds,
           CASE WHEN event_id % 53 = 0 THEN 'received_proxy' ELSE 'http_date' END AS origin,
           (event_id % 60) * 100 AS latency_ms
    FROM quotes_dense
    """,
    "quotes_dense",
)


def quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse quotes per user with every kind of quality problem."""
    df = _sides(ticks(table(spark, folder, "events")))
    event = F.col("event_id")
    return df.withColumns(
        {
            "symbol": F.concat(F.lit("U"), F.col("user_id").cast("string")),
            "symbol_id": F.col("user_id"),
            "provider": F.lit("live"),
            "bid_price": F.when(event % 101 == 0, F.lit(None).cast("double"))
            .when(event % 103 == 0, F.col("ask_price") * 1.01)
            .when(event % 107 == 0, F.lit(0.0))
            .otherwise(F.col("bid_price")),
            "is_halted": F.col("event_type") == "error",
            "delay_seconds": F.when(event % 97 == 0, 15).otherwise(0),
            "source_time_origin": F.when(event % 53 == 0, "received_proxy").otherwise("http_date"),
            "latency_ms": (event % 60) * 100,
        }
    )


# ---- bars and plans -----------------------------------------------------------------

sql_view(
    "deltas",
    """
    SELECT *, CASE WHEN prev IS NULL OR volume < prev THEN volume ELSE volume - prev END
                AS volume_delta
    FROM (SELECT *, lag(volume) OVER (PARTITION BY symbol, session ORDER BY received_us) AS prev
          FROM quotes_dense)
    """,
    "quotes_dense",
)
sql_view(
    "bars",
    """
    SELECT symbol, session, received_us // 3600000000 * 3600000000 AS start_us,
           arg_min(price, received_us) AS open, max(price) AS high, min(price) AS low,
           arg_max(price, received_us) AS close, CAST(sum(volume_delta) AS DOUBLE) AS volume
    FROM deltas GROUP BY ALL
    """,
    "deltas",
)


def bars(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars of the busy symbols."""
    from tidemark.operators.bars import resample

    return resample(quotes_dense(spark, folder), 60)


sql_view(
    "plans",
    """
    SELECT symbol, session, symbol || ':' || session AS snapshot_id,
           day_us + 6 * 3600000000 AS valid_us, day_us + 18 * 3600000000 AS expires_us,
           110.0::DOUBLE + d % 5 AS entry, 100.5::DOUBLE + 0.3::DOUBLE * (d % 3) AS stop,
           118.0::DOUBLE + d % 4 AS target, 1 + d % 3 AS quantity
    FROM (SELECT DISTINCT symbol, session,
                 received_us // 86400000000 * 86400000000 AS day_us,
                 day(ts) AS d
          FROM quotes_dense)
    """,
    "quotes_dense",
)


def plans(spark: SparkSession, folder: str) -> DataFrame:
    """One plan per busy symbol and session, from the day of the month alone."""
    keys = quotes_dense(spark, folder).select("symbol", "session_date").distinct()
    d = F.dayofmonth("session_date")
    midnight = F.unix_micros(F.col("session_date").cast("timestamp"))
    return keys.select(
        "symbol",
        "session_date",
        F.concat_ws(":", "symbol", day_text("session_date")).alias("snapshot_id"),
        F.timestamp_micros(midnight + 6 * 3_600_000_000).alias("valid_from"),
        F.timestamp_micros(midnight + 18 * 3_600_000_000).alias("expires_at"),
        (F.lit(110.0) + d % 5).alias("entry"),
        (F.lit(100.5) + F.lit(0.3) * (d % 3)).alias("stop"),
        (F.lit(118.0) + d % 4).alias("target"),
        (1 + d % 3).alias("quantity"),
    )


# ---- cross-section of parts ---------------------------------------------------------

sql_view(
    "candidates",
    """
    SELECT 'P' || p_partkey AS symbol, 'sec:' || p_partkey AS security_id, p_partkey AS partkey,
           CASE WHEN p_partkey % 4 = 0 THEN 'NYSE' ELSE 'NASDAQ' END AS exchange,
           CASE WHEN p_partkey % 41 = 0 THEN 'fund' ELSE 'common_stock' END AS asset_type,
           CASE WHEN p_size % 10 = 0 THEN 'UNKNOWN' ELSE p_type END AS sector,
           p_retailprice / 9.5::DOUBLE AS price,
           CAST((p_partkey * 7919) % 100003 AS DOUBLE) * p_size AS median_dollar_volume,
           (p_partkey % 30) / 1000.0::DOUBLE AS spread_pct,
           (p_partkey % 97) / 1500.0::DOUBLE AS volatility,
           least(1.0::DOUBLE, 0.80::DOUBLE + (p_partkey % 23) / 100.0::DOUBLE) AS coverage_ratio,
           p_partkey % 37 <> 0 AS active, p_partkey % 43 <> 0 AS provider_resolvable,
           p_partkey % 47 <> 0 AS corporate_action_ok, p_partkey % 19 = 0 AS is_ipo,
           p_partkey % 40 AS listing_sessions, p_size AS size
    FROM part
    """,
)


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    key = F.col("p_partkey")
    return part.select(
        F.concat(F.lit("P"), key.cast("string")).alias("symbol"),
        F.concat(F.lit("sec:"), key.cast("string")).alias("security_id"),
        key.alias("partkey"),
        F.when(key % 4 == 0, "NYSE").otherwise("NASDAQ").alias("exchange"),
        F.when(key % 41 == 0, "fund").otherwise("common_stock").alias("asset_type"),
        F.when(F.col("p_size") % 10 == 0, "UNKNOWN").otherwise(F.col("p_type")).alias("sector"),
        (F.col("p_retailprice") / F.lit(9.5)).alias("price"),
        (((key * 7919) % 100003).cast("double") * F.col("p_size")).alias("median_dollar_volume"),
        ((key % 30) / F.lit(1000.0)).alias("spread_pct"),
        ((key % 97) / F.lit(1500.0)).alias("volatility"),
        F.least(F.lit(1.0), F.lit(0.80) + (key % 23) / F.lit(100.0)).alias("coverage_ratio"),
        (key % 37 != 0).alias("active"),
        (key % 43 != 0).alias("provider_resolvable"),
        (key % 47 != 0).alias("corporate_action_ok"),
        (key % 19 == 0).alias("is_ipo"),
        (key % 40).alias("listing_sessions"),
        F.col("p_size").alias("size"),
    )


sql_view(
    "candidates_day",
    """
    SELECT symbol, partkey, sector, size, price, '2024-03-04' AS session,
           price * (1 - spread_pct / 2) AS bid, price * (1 + spread_pct / 2) AS ask,
           CAST((partkey * 37) % 5000 AS BIGINT) AS volume,
           0.5::DOUBLE + (partkey % 29) / 10.0::DOUBLE AS rvol, volatility,
           price * (0.97::DOUBLE + (partkey % 7) / 100.0::DOUBLE) AS vwap,
           price * (0.98::DOUBLE + (partkey % 5) / 100.0::DOUBLE) AS opening_range_high,
           price * (0.94::DOUBLE + (partkey % 3) / 100.0::DOUBLE) AS opening_range_low,
           partkey % 59 <> 0 AS fresh, partkey % 61 = 0 AS delayed, partkey % 67 = 0 AS halted,
           (partkey % 11) / 10.0::DOUBLE AS market_score,
           CASE WHEN partkey % 3 = 0 THEN NULL ELSE (partkey % 13) / 12.0::DOUBLE END AS news_score,
           CASE WHEN partkey % 4 = 0 THEN NULL ELSE (partkey % 17) / 16.0::DOUBLE END AS social_score,
           CASE WHEN partkey % 5 = 0 THEN NULL ELSE (partkey % 7) / 6.0::DOUBLE END AS fundamental_score,
           (partkey % 21) / 20.0::DOUBLE AS extended_score
    FROM candidates
    """,
    "candidates",
)


def candidates_day(spark: SparkSession, folder: str) -> DataFrame:
    df = candidates(spark, folder)
    key, price = F.col("partkey"), F.col("price")

    def part(modulus: int, divisor: float) -> Column:
        return (key % modulus) / F.lit(divisor)

    def optional(skip: int, value: Column) -> Column:
        return F.when(key % skip != 0, value)

    return df.select(
        "symbol",
        "partkey",
        "sector",
        "size",
        "price",
        F.lit("2024-03-04").alias("session"),
        (price * (1 - F.col("spread_pct") / 2)).alias("bid"),
        (price * (1 + F.col("spread_pct") / 2)).alias("ask"),
        ((key * 37) % 5000).alias("volume"),
        (F.lit(0.5) + part(29, 10.0)).alias("rvol"),
        "volatility",
        (price * (F.lit(0.97) + part(7, 100.0))).alias("vwap"),
        (price * (F.lit(0.98) + part(5, 100.0))).alias("opening_range_high"),
        (price * (F.lit(0.94) + part(3, 100.0))).alias("opening_range_low"),
        (key % 59 != 0).alias("fresh"),
        (key % 61 == 0).alias("delayed"),
        (key % 67 == 0).alias("halted"),
        part(11, 10.0).alias("market_score"),
        optional(3, part(13, 12.0)).alias("news_score"),
        optional(4, part(17, 16.0)).alias("social_score"),
        optional(5, part(7, 6.0)).alias("fundamental_score"),
        part(21, 20.0).alias("extended_score"),
    )

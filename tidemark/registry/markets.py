"""As-of, quality, coverage, extended-hours and outcome queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import coverage, extended, outcomes, quality
from tidemark.operators import features as feature_ops
from tidemark.policies import ExecutionProfile, ExtendedThresholds, FeatureWindows
from tidemark.plans import candidates
from tidemark.registry.core import query, sql_view, table
from tidemark.registry.views import bars, day_text, plans, quotes, quotes_dense, us

ET = "timezone('America/New_York', timezone('UTC', make_timestamp({})))"


@query(
    "relative_strength_asof",
    """
WITH bench AS (SELECT session, received_us, price AS b FROM quotes_dense WHERE symbol = 'view'),
joined AS (
  SELECT q.*, bench.b FROM quotes_dense q ASOF LEFT JOIN bench
    ON q.session = bench.session AND q.received_us >= bench.received_us),
based AS (
  SELECT *, first_value(price) OVER w AS p0, first_value(b) OVER w AS b0 FROM joined
  WINDOW w AS (PARTITION BY symbol, session ORDER BY received_us))
SELECT event_id, symbol, received_us,
       round(CASE WHEN b0 IS NOT NULL THEN (price / p0 - 1) - (b / b0 - 1) END, 8)
         AS market_relative_strength
FROM based
""",
    "quotes_dense",
)
def relative_strength_asof(spark: SparkSession, folder: str) -> DataFrame:
    samples = quotes_dense(spark, folder)
    benchmark = samples.filter(F.col("symbol") == "view")
    return feature_ops.market_features(samples, market=benchmark).select(
        "event_id",
        "symbol",
        us("received_at").alias("received_us"),
        F.round("market_relative_strength", 8).alias("market_relative_strength"),
    )


@query(
    "manual_fill_forward_asof",
    """
WITH signals AS (
  SELECT snapshot_id, symbol, session, valid_us,
         CASE WHEN quantity = 1 THEN 'sell' ELSE 'buy' END AS side FROM plans)
SELECT s.snapshot_id, s.side, q.received_us AS fill_us,
       round(q.price * CASE WHEN s.side = 'buy' THEN 1.001 ELSE 0.999 END, 6) AS fill_price
FROM signals s ASOF LEFT JOIN quotes_dense q
  ON s.symbol = q.symbol AND s.session = q.session AND s.valid_us + 90000000 <= q.received_us
""",
    "plans",
    "quotes_dense",
)
def manual_fill_forward_asof(spark: SparkSession, folder: str) -> DataFrame:
    signals = plans(spark, folder).select(
        "snapshot_id", "symbol", "session_date", F.col("valid_from").alias("signal_at"),
        F.when(F.col("quantity") == 1, "sell").otherwise("buy").alias("side"),
    )
    observed = quotes_dense(spark, folder).select(
        "symbol", "session_date", F.col("received_at").alias("observed_at"),
        F.col("last_trade_price").alias("price"),
    )
    profile = ExecutionProfile(slippage_bps=10, manual_latency_seconds=90)
    return outcomes.manual_fills(signals, observed, profile).select(
        "snapshot_id", "side", us("fill_at").alias("fill_us"),
        F.round("fill_price", 6).alias("fill_price"),
    )


@query(
    "reference_returns",
    """
WITH firsts AS (
  SELECT p.snapshot_id, p.symbol, p.session, p.valid_us, arg_min(b.close, b.start_us) AS base
  FROM plans p JOIN bars b ON p.symbol = b.symbol AND p.session = b.session
   AND b.start_us >= p.valid_us GROUP BY ALL),
marks AS (
  SELECT f.*, m AS minutes, valid_us + m::BIGINT * 60000000 AS due
  FROM firsts f CROSS JOIN (SELECT unnest([5, 15, 30, 60, 240]) AS m))
SELECT m.snapshot_id, m.minutes, b.start_us AS bar_us,
       round((b.close - m.base) / m.base, 8) AS reference_return
FROM marks m ASOF LEFT JOIN bars b
  ON m.symbol = b.symbol AND m.session = b.session AND m.due <= b.start_us
""",
    "plans",
    "bars",
)
def reference_returns(spark: SparkSession, folder: str) -> DataFrame:
    b = bars(spark, folder)
    starts = (
        plans(spark, folder)
        .join(b, ["symbol", "session_date"])
        .filter(F.col("start") >= F.col("valid_from"))
        .groupBy("snapshot_id", "symbol", "session_date", F.col("valid_from").alias("baseline_at"))
        .agg(F.min_by("close", "start").alias("baseline"))
    )
    return outcomes.reference_returns(starts, b, (5, 15, 30, 60, 240)).select(
        "snapshot_id", "minutes", us("bar_at").alias("bar_us"),
        F.round("reference_return", 8).alias("reference_return"),
    )


@query(
    "pit_replay_features",
    f"""
WITH local AS (SELECT *, {ET.format("source_us")} AS et FROM deltas),
flagged AS (SELECT *, hour(et) * 60 + minute(et) BETWEEN 570 AND 599 AS inside FROM local)
SELECT event_id, symbol, received_us,
       CAST(count(*) OVER w AS BIGINT) AS prefix_rows,
       round(max(CASE WHEN inside THEN price END) OVER w, 6) AS opening_range_high,
       round(min(CASE WHEN inside THEN price END) OVER w, 6) AS opening_range_low,
       round(sum(price * volume_delta) OVER w / nullif(sum(volume_delta) OVER w, 0), 6) AS vwap
FROM flagged
WINDOW w AS (PARTITION BY symbol, session ORDER BY received_us ROWS UNBOUNDED PRECEDING)
""",
    "deltas",
)
def pit_replay_features(spark: SparkSession, folder: str) -> DataFrame:
    """Each row's features from its own prefix only, in one pass."""
    from tidemark.operators.segments import KeyedSeries, Segmentation

    samples = quotes_dense(spark, folder)
    cut = Segmentation.for_input(samples, feature_ops.KEYS, F.unix_micros("received_at"))
    features = feature_ops.market_features(
        samples,
        windows=FeatureWindows(opening_range_minutes=30),
        running_opening_range=True,
        segmentation=cut,
    ).withColumn("__us", F.unix_micros("received_at"))
    series = KeyedSeries(features, feature_ops.KEYS, ["__us"], cut)
    series.accumulate(sums={"prefix_rows": F.lit(1)})
    return series.finish().select(
        "event_id",
        "symbol",
        us("received_at").alias("received_us"),
        F.col("prefix_rows").cast("long").alias("prefix_rows"),
        F.round("opening_range_high", 6).alias("opening_range_high"),
        F.round("opening_range_low", 6).alias("opening_range_low"),
        F.round("vwap", 6).alias("vwap"),
    )


@query(
    "opening_range_check",
    f"""
WITH local AS (SELECT symbol, session, {ET.format("source_us")} AS et FROM quotes_dense),
m AS (SELECT symbol, session, hour(et) * 60 + minute(et) AS minute,
             hour(et) * 3600 + minute(et) * 60 + floor(second(et)) AS sec FROM local)
SELECT symbol, session, CAST(count_if(minute BETWEEN 570 AND 574) AS BIGINT) AS opening_rows,
       CAST(count(DISTINCT CASE WHEN minute BETWEEN 570 AND 574 THEN minute END) AS BIGINT) AS opening_minutes,
       count_if(minute BETWEEN 570 AND 574) = 5 AND
         count(DISTINCT CASE WHEN minute BETWEEN 570 AND 574 THEN minute END) = 5 AS complete,
       count(DISTINCT CASE WHEN minute BETWEEN 570 AND 574 THEN minute END) = 5
         AND max(sec) >= 34500 AS covered
FROM m GROUP BY ALL
""",
    "quotes_dense",
)
def opening_range_check(spark: SparkSession, folder: str) -> DataFrame:
    return feature_ops.opening_range_check(quotes_dense(spark, folder)).select(
        "symbol", day_text("session_date").alias("session"), "opening_rows", "opening_minutes",
        "complete", "covered",
    )


VERDICT_SQL = """CASE WHEN delay_seconds <> 0 THEN 'DELAYED_QUOTE' WHEN is_halted THEN 'HALTED'
  WHEN origin <> 'http_date' THEN 'SOURCE_TIME_UNVERIFIED' WHEN latency_ms > 5000 THEN 'STALE_QUOTE'
  WHEN bid IS NULL OR ask IS NULL OR last_trade_price IS NULL THEN 'INCOMPLETE_LEVEL1'
  WHEN bid <= 0 OR ask <= 0 OR last_trade_price <= 0 THEN 'INVALID_PRICE'
  WHEN ask < bid THEN 'CROSSED_MARKET' END"""
PHASE_SQL = """CASE WHEN minute_et >= 240 AND minute_et < 570 THEN 'PRE_MARKET'
  WHEN minute_et >= 570 AND minute_et < 960 THEN 'REGULAR'
  WHEN minute_et >= 960 AND minute_et < 1200 THEN 'POST_MARKET' END"""
sql_view(
    "classified",
    f"""
    SELECT *, {VERDICT_SQL} AS invalid_reason, {PHASE_SQL} AS session_phase
    FROM (SELECT *, hour(et) * 60 + minute(et) AS minute_et, strftime(et, '%Y-%m-%d') AS session_et
          FROM (SELECT *, {ET.format("source_us")} AS et FROM quotes))
    """,
    "quotes",
)


@query(
    "quote_quality",
    """SELECT event_id, symbol, invalid_reason, invalid_reason IS NULL AS is_trade_eligible
       FROM classified""",
    "classified",
)
def quote_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify_quotes(quotes(spark, folder)).select(
        "event_id", "symbol", "invalid_reason", "is_trade_eligible"
    )


@query(
    "session_phase",
    "SELECT event_id, session_et AS session, session_phase FROM classified",
    "classified",
)
def session_phase(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify_quotes(quotes(spark, folder)).select(
        "event_id", day_text("session_date").alias("session"), "session_phase"
    )


@query(
    "latest_quotes",
    """SELECT symbol, event_id, received_us, round(last_trade_price, 6) AS last_trade_price
       FROM quotes QUALIFY row_number() OVER
         (PARTITION BY symbol ORDER BY received_us DESC, event_id DESC) = 1""",
    "quotes",
)
def latest_quotes(spark: SparkSession, folder: str) -> DataFrame:
    return quality.latest_quotes(quotes(spark, folder)).select(
        "symbol", "event_id", us("received_at").alias("received_us"),
        F.round("last_trade_price", 6).alias("last_trade_price"),
    )


@query(
    "watchlist_quotes",
    """
WITH latest AS (SELECT symbol, event_id FROM quotes QUALIFY row_number() OVER
  (PARTITION BY symbol ORDER BY received_us DESC, event_id DESC) = 1)
SELECT c_custkey AS position, symbol, event_id FROM customer JOIN latest ON symbol = 'U' || c_custkey""",
    "quotes",
)
def watchlist_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """Latest quotes of a watchlist that is written in another case and with blanks."""
    wanted = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("position"),
        F.concat(F.lit(" u"), F.col("c_custkey").cast("string")).alias("symbol"),
    )
    latest = quality.latest_quotes(quotes(spark, folder))
    return candidates.watchlist_quotes(latest, wanted).select("position", "symbol", "event_id")


@query(
    "retention",
    """SELECT session, CAST(count(*) AS BIGINT) AS kept FROM quotes
       WHERE received_us >= epoch_us(TIMESTAMP '2024-02-10') - 30 * 86400000000 GROUP BY session""",
    "quotes",
)
def retention(spark: SparkSession, folder: str) -> DataFrame:
    kept = quality.keep_since(quotes(spark, folder), F.lit("2024-02-10").cast("timestamp"))
    return kept.groupBy(day_text("session_date").alias("session")).agg(F.count("*").alias("kept"))



sql_view(
    "sessions",
    """
    SELECT d AS session_date, strftime(d, '%Y-%m-%d') AS session,
           CAST(epoch_us(d) AS BIGINT) AS day_us
    FROM (SELECT unnest(generate_series((SELECT date_trunc('day', min(ts)) - INTERVAL 10 DAY FROM events),
                                        (SELECT date_trunc('day', max(ts)) + INTERVAL 10 DAY FROM events), INTERVAL 1 DAY)) AS d)
    WHERE isodow(d) < 6 AND strftime(d, '%Y-%m-%d') NOT IN (
      '2023-11-23', '2023-12-25', '2024-01-01', '2024-01-15', '2024-02-19', '2024-03-29', '2024-05-27', '2024-06-19',
      '2024-07-04', '2024-09-02', '2024-11-28', '2024-12-25', '2025-01-01', '2025-01-09', '2025-01-20')
    """,
)


RETURN_SQL = """
WITH known AS (
  SELECT *, length(symbol) % 2 AS grp, event_id % 9 <> 0 AS ok,
         day_us + 68400000000 AS cutoff
  FROM (SELECT *, received_us // 86400000000 * 86400000000 AS day_us FROM quotes_dense)
  WHERE received_us <= day_us + 68400000000),
flagged AS (
  SELECT *, ok AND hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 960
    AND strftime(et, '%Y-%m-%d') IN (SELECT session FROM sessions) AS good
  FROM (SELECT *, {et} AS et FROM known)),
per AS (
  SELECT grp, session, symbol, count_if(good) AS n,
         arg_min(price, received_us) FILTER (good) AS p0,
         arg_max(price, received_us) FILTER (good) AS p1,
         arg_max(ok, received_us) AS elig, max(cutoff) - max(received_us) AS age
  FROM flagged GROUP BY ALL),
u AS (SELECT *, CASE WHEN n >= 2 AND elig AND age BETWEEN 0 AND 300000000 THEN p1 / p0 - 1 END AS r
      FROM per)
SELECT grp, session, CAST(count(*) AS BIGINT) AS members, CAST(count(r) AS BIGINT) AS used,
       round(CASE WHEN {keep} THEN avg(r) END, 8) AS group_return
FROM u GROUP BY ALL
"""


def _group_return(spark: SparkSession, folder: str, strict: bool) -> DataFrame:
    df = quotes_dense(spark, folder).withColumns(
        {"grp": F.length("symbol") % 2, "is_trade_eligible": F.col("event_id") % 9 != 0}
    )
    cutoff = F.col("session_date").cast("timestamp") + F.expr("INTERVAL 19 HOURS")
    return quality.group_return(df, cutoff, by=["grp"], strict=strict).select(
        "grp", day_text("session_date").alias("session"), "members", "used",
        F.round("group_return", 8).alias("group_return"),
    )


@query(
    "benchmark_return",
    RETURN_SQL.format(et=ET.format("received_us"), keep="count(r) = count(*)"),
    "quotes_dense",
    "sessions",
)
def benchmark_return(spark: SparkSession, folder: str) -> DataFrame:
    return _group_return(spark, folder, True)


@query(
    "sector_return",
    RETURN_SQL.format(et=ET.format("received_us"), keep="count(r) > 0"),
    "quotes_dense",
    "sessions",
)
def sector_return(spark: SparkSession, folder: str) -> DataFrame:
    return _group_return(spark, folder, False)


@query(
    "decision_candidates",
    f"""
WITH q AS (SELECT *, {ET.format("received_us")} AS et, {ET.format("source_us")} AS st, event_id % 9 <> 0 AS ok FROM quotes_dense),
r AS (SELECT *, hour(st) * 60 + minute(st) AS m FROM q
      WHERE ok AND hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < CASE
          WHEN month(et) = 7 AND day(et) = 3 AND isodow(et) < 5 OR month(et) = 11 AND isodow(et) = 5 AND day(et) BETWEEN 23 AND 29
            OR month(et) = 12 AND day(et) = 24 AND isodow(et) < 6 THEN 780 ELSE 960 END
        AND strftime(et, '%Y-%m-%d') IN (SELECT session FROM sessions)),
c AS (SELECT symbol, session, count(DISTINCT m) FILTER (m BETWEEN 570 AND 574) = 5 AND max(m) >= 575 AS covered FROM r GROUP BY ALL),
v AS (SELECT * FROM r WHERE isfinite(price) AND isfinite(bid) AND isfinite(ask) AND least(price, bid, ask) > 0 AND volume >= 0 AND ask >= bid
      QUALIFY row_number() OVER (PARTITION BY symbol, session, received_us ORDER BY price DESC, event_id DESC, user_id DESC, volume DESC) = 1),
d AS (SELECT *, CAST(CASE WHEN volume >= lag(volume) OVER w THEN volume - lag(volume) OVER w ELSE volume END AS DOUBLE) AS delta,
             price / lag(price) OVER w - 1 AS ret
      FROM v WINDOW w AS (PARTITION BY symbol, session ORDER BY received_us)),
f AS (SELECT symbol, session, received_us, delta,
             avg(delta) OVER (PARTITION BY symbol, session ORDER BY received_us ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS prior,
             count(ret) OVER (PARTITION BY symbol, session ORDER BY received_us ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS returns,
             sum(price * delta) OVER (PARTITION BY symbol, session) AS traded, sum(delta) OVER (PARTITION BY symbol, session) AS total,
             count_if(m BETWEEN 570 AND 574) OVER (PARTITION BY symbol, session) AS opening
      FROM d),
l AS (SELECT symbol, session, coalesce(returns = 5 AND prior > 0 AND isfinite(delta / prior) AND total > 0 AND isfinite(traded / total)
             AND opening > 0, FALSE) AS complete
      FROM f QUALIFY row_number() OVER (PARTITION BY symbol, session ORDER BY received_us DESC) = 1)
SELECT symbol, session, CASE WHEN complete IS NULL THEN 'candidate:no_samples' WHEN NOT coalesce(covered, FALSE) THEN 'candidate:opening_gap'
  WHEN NOT complete THEN 'candidate:features_missing' END AS reason
FROM (SELECT DISTINCT symbol, session FROM q) LEFT JOIN c USING (symbol, session) LEFT JOIN l USING (symbol, session)
""",
    "quotes_dense",
    "sessions",
)
def decision_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Raw quotes to candidates: why each symbol may or may not enter the session's decision."""
    samples = quotes_dense(spark, folder).withColumn("is_trade_eligible", F.col("event_id") % 9 != 0)
    cutoff = F.col("session_date").cast("timestamp") + F.expr("INTERVAL 23 HOURS")
    market = quality.group_return(samples, cutoff, strict=False).select(
        "session_date", F.col("group_return").alias("benchmark_return")
    )
    identity = samples.select("symbol", F.substring("symbol", 1, 1).alias("sector")).distinct()
    return candidates.candidate_rows(samples, market, identity).select(
        "symbol", day_text("session_date").alias("session"), "reason"
    )


# ---- calendar and coverage ----------------------------------------------------------

def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions over the whole span of the events, with a margin for neighbours."""
    events = table(spark, folder, "events")
    first = events.agg(F.date_sub(F.to_date(F.min("ts")), 10)).scalar()
    last = events.agg(F.date_add(F.to_date(F.max("ts")), 10)).scalar()
    return cal.trading_calendar(spark, first, last)


@query(
    "trading_days",
    """
WITH first_last AS (SELECT session, session_date,
    lag(session) OVER (ORDER BY session_date) AS previous_session,
    lead(session_date) OVER (ORDER BY session_date) AS nxt FROM sessions),
used AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS session FROM events)
SELECT f.session, previous_session,
       coalesce(month(nxt) <> month(session_date), TRUE) AS last_of_month,
       CAST(epoch_us(session_date) + 52200000000 AS BIGINT) AS open_us,
       CAST(epoch_us(session_date) + 75600000000 AS BIGINT) AS close_us
FROM first_last f JOIN used USING (session)
""",
    "sessions",
)
def trading_days(spark: SparkSession, folder: str) -> DataFrame:
    """Calendar rows of the sessions on which events occur."""
    used = quotes_dense(spark, folder).select(F.col("session_date").alias("session")).distinct()
    return sessions(spark, folder).join(used, "session").select(
        day_text("session").alias("session"),
        day_text("previous_session").alias("previous_session"),
        "last_of_month",
        us("regular_open").alias("open_us"),
        us("regular_close").alias("close_us"),
    )


def _grid(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hourly bars, the keys expected of them, and a 06:00-18:00 schedule."""
    b = bars(spark, folder)
    keys = b.select("symbol", "session_date").distinct()
    midnight = F.col("session_date").cast("timestamp")
    schedule = keys.select("session_date").distinct().select(
        "session_date",
        (midnight + F.expr("INTERVAL 6 HOURS")).alias("open_at"),
        (midnight + F.expr("INTERVAL 18 HOURS")).alias("close_at"),
    )
    return b, keys, schedule


sql_view(
    "grid",
    """
    SELECT symbol, session, day_us + h * 3600000000 AS start_us
    FROM (SELECT DISTINCT symbol, session, start_us // 86400000000 * 86400000000 AS day_us FROM bars)
    CROSS JOIN (SELECT unnest(range(6, 18)) AS h)
    """,
    "bars",
)


@query(
    "minute_coverage",
    "SELECT * FROM grid ANTI JOIN bars USING (symbol, session, start_us)",
    "grid",
    "bars",
)
def minute_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Expected bar starts without a bar."""
    b, keys, schedule = _grid(spark, folder)
    return coverage.missing_minutes(b, keys, schedule, 60).select(
        "symbol", day_text("session_date").alias("session"), us("start").alias("start_us")
    )


sql_view(
    "status",
    """
    SELECT symbol, session, CAST(count(b.start_us) AS BIGINT) AS n, count(*) - count(b.start_us) AS missing,
           CASE WHEN count(b.start_us) = 0 THEN 'missing'
                WHEN count(b.start_us) < 12 THEN 'incomplete' ELSE 'complete' END AS status,
           CASE WHEN count(b.start_us) = 0 THEN 'provider returned no candles'
                WHEN count(b.start_us) < 12
                THEN 'provider missing ' || (12 - count(b.start_us)) || ' minute(s)' END AS reason
    FROM grid LEFT JOIN bars b USING (symbol, session, start_us) GROUP BY symbol, session
    """,
    "grid",
    "bars",
)


@query(
    "coverage_status",
    """SELECT symbol, session, n AS rows, status, reason,
              CAST(CASE WHEN n = 0 THEN 0 ELSE missing END AS BIGINT) AS missing FROM status""",
    "status",
)
def coverage_status(spark: SparkSession, folder: str) -> DataFrame:
    b, keys, schedule = _grid(spark, folder)
    return coverage.coverage_status(b, keys, schedule, 60).select(
        "symbol", day_text("session_date").alias("session"), F.col("rows").cast("long").alias("rows"),
        "status", "reason", F.size("missing").cast("long").alias("missing"),
    )


def _accepted(spark: SparkSession, folder: str, trades: DataFrame | None, **options: bool) -> DataFrame:
    b, keys, schedule = _grid(spark, folder)
    first = coverage.coverage_status(b, keys, schedule, 60)
    # The second look lost every bar of the fifth of the month at noon.
    again = b.filter(~((F.dayofmonth("start") == 5) & (F.hour("start") == 12)))
    second = coverage.coverage_status(again, keys, schedule, 60)
    return coverage.accept_gaps(first, second, trades, 60, **options)


@query(
    "gap_acceptance",
    """
WITH hole AS (SELECT symbol, session FROM bars
              WHERE session LIKE '%-05' AND start_us % 86400000000 = 43200000000)
SELECT symbol, session, CAST(CASE WHEN n = 0 THEN 0 ELSE missing END AS BIGINT) AS missing_minutes,
       CASE WHEN accepted THEN 'accepted_gap' ELSE status END AS status,
       CASE WHEN accepted THEN 'provider missing minute' ELSE reason END AS reason
FROM (SELECT s.*, n > 0 AND missing BETWEEN 1 AND 5 AND h.symbol IS NULL AS accepted
      FROM status s LEFT JOIN hole h USING (symbol, session))
""",
    "status",
    "bars",
)
def gap_acceptance(spark: SparkSession, folder: str) -> DataFrame:
    return _accepted(spark, folder, None).select(
        "symbol", day_text("session_date").alias("session"), "status", "reason",
        F.col("missing_minutes").cast("long").alias("missing_minutes"),
    )


TRADE_SQL = """CASE WHEN code NOT IN ('@', 'F', 'T', 'B', 'C', 'Z') THEN TRUE
  WHEN code IN ('C', 'Z') THEN FALSE WHEN code = 'B' AND tape IN ('A', 'B') THEN FALSE
  ELSE size > 0 END"""
sql_view(
    "trades",
    f"""
    SELECT *, {TRADE_SQL} AS creates_bar FROM (
      SELECT l_orderkey, l_linenumber, l_partkey,
             ['@', 'F', 'T', 'B', 'C', 'Z', '?'][1 + CAST(l_orderkey % 7 AS INTEGER)] AS code,
             CASE WHEN l_linenumber % 2 = 0 THEN 'A' ELSE 'C' END AS tape,
             l_quantity - 10 AS size FROM lineitem)
    """,
)


def trades(spark: SparkSession, folder: str) -> DataFrame:
    line = table(spark, folder, "lineitem")
    codes = F.array(*[F.lit(code) for code in ("@", "F", "T", "B", "C", "Z", "?")])
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.get(codes, (F.col("l_orderkey") % 7).cast("int")).alias("code"),
        F.when(F.col("l_linenumber") % 2 == 0, "A").otherwise("C").alias("tape"),
        (F.col("l_quantity") - 10).alias("size"),
    ).withColumn(
        "creates_bar", quality.can_create_bar(F.array("code"), F.col("tape"), F.col("size"))
    )


@query(
    "bar_eligible_trades",
    """SELECT code, tape, creates_bar, CAST(count(*) AS BIGINT) AS trades FROM trades GROUP BY ALL""",
    "trades",
)
def bar_eligible_trades(spark: SparkSession, folder: str) -> DataFrame:
    return trades(spark, folder).groupBy("code", "tape", "creates_bar").agg(
        F.count("*").alias("trades")
    )


@query(
    "sparse_gaps",
    """
WITH t AS (SELECT DISTINCT other.symbol, session, received_us // 3600000000 * 3600000000 AS start_us
           FROM quotes_dense q, (SELECT DISTINCT symbol FROM quotes_dense) other
           WHERE other.symbol <> q.symbol AND event_id % 4 = 0),
gap AS (SELECT * FROM grid ANTI JOIN bars USING (symbol, session, start_us)),
contradicted AS (SELECT DISTINCT symbol, session FROM gap SEMI JOIN t USING (symbol, session, start_us)),
hole AS (SELECT symbol, session FROM bars
         WHERE session LIKE '%-05' AND start_us % 86400000000 = 43200000000)
SELECT symbol, session, CASE WHEN ok THEN 'accepted_sparse' ELSE status END AS status
FROM (SELECT s.*, n > 0 AND missing > 0 AND h.symbol IS NULL AND c.symbol IS NULL AS ok
      FROM status s LEFT JOIN hole h USING (symbol, session)
      LEFT JOIN contradicted c USING (symbol, session))
""",
    "status",
    "quotes_dense",
)
def sparse_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Gaps nobody traded in: the other symbols' ticks stand in for a symbol's trade prints."""
    ticks = quotes_dense(spark, folder)
    prints = ticks.select(
        "symbol", F.col("received_at").alias("traded_at"), (F.col("event_id") % 4 == 0).alias("creates_bar")
    )
    return _accepted(spark, folder, prints, of_others=True).select(
        "symbol", day_text("session_date").alias("session"), "status"
    )


@query(
    "coverage_summary",
    """
WITH days AS (SELECT DISTINCT symbol, session FROM bars WHERE session IN (SELECT session FROM sessions)),
span AS (SELECT min(session) AS a, max(session) AS b FROM days),
need AS (SELECT symbol, session FROM (SELECT DISTINCT symbol FROM days)
         CROSS JOIN (SELECT session FROM sessions, span WHERE session BETWEEN a AND b)),
e AS (SELECT * FROM status),
j AS (SELECT d.symbol, d.session, e.status FROM days d LEFT JOIN e USING (symbol, session))
SELECT CAST((SELECT count(*) FROM j) AS BIGINT) AS expected,
       (SELECT min(session) FROM j WHERE status = 'complete') AS first_covered,
       (SELECT max(session) FROM j WHERE status = 'complete') AS last_covered,
       (SELECT bool_and(coalesce(status = 'complete', FALSE)) FROM j) AS all_complete,
       (SELECT count(*) FROM need) = (SELECT count(*) FROM days) AS continuous,
       CAST((SELECT count(*) FROM e WHERE status = 'complete') AS BIGINT) AS complete,
       CAST((SELECT count(*) FROM e WHERE status = 'incomplete') AS BIGINT) AS incomplete,
       CAST((SELECT count(*) FROM e WHERE status = 'missing') AS BIGINT) AS missing
""",
    "status",
    "sessions",
    "bars",
)
def coverage_summary(spark: SparkSession, folder: str) -> DataFrame:
    b, keys, schedule = _grid(spark, folder)
    entries = coverage.coverage_status(b, keys, schedule, 60)
    expected = coverage.trading_keys(keys)
    return coverage.coverage_summary(entries, expected).select(
        "expected", day_text("first_covered").alias("first_covered"),
        day_text("last_covered").alias("last_covered"), "all_complete", "continuous",
        "complete", "incomplete", "missing",
    )


# ---- extended hours -----------------------------------------------------------------

sql_view(
    "phased",
    f"""
    SELECT *, {PHASE_SQL} AS phase FROM (
      SELECT *, hour(et) * 60 + minute(et) AS minute_et
      FROM (SELECT *, {ET.format("start_us")} AS et FROM bars))
    """,
    "bars",
)
sql_view(
    "phase_rows",
    """
    WITH closes AS (SELECT symbol, session, arg_max(close, start_us) AS pc FROM phased
                    WHERE phase = 'REGULAR' GROUP BY ALL),
    cal AS (SELECT session, lag(session) OVER (ORDER BY session) AS prev FROM sessions),
    b AS (SELECT p.*, pc, cal.prev,
                 close / lag(close) OVER (PARTITION BY p.symbol, p.session, phase ORDER BY start_us) - 1 AS ret
          FROM phased p JOIN cal USING (session)
          LEFT JOIN closes c ON c.symbol = p.symbol AND c.session = cal.prev
          WHERE phase IS NOT NULL)
    SELECT symbol, session, prev, phase, count(*) AS active_minutes, sum(close * volume) AS dollar_volume,
           arg_max(close, start_us) / arg_min(open, start_us) - 1 AS return_pct,
           CASE WHEN phase = 'PRE_MARKET' THEN arg_max(close, start_us) / max(pc) - 1 END AS gap_pct,
           max(high) / min(low) - 1 AS range_pct, coalesce(stddev_pop(ret), 0) AS volatility,
           sum(volume) AS volume
    FROM b GROUP BY symbol, session, prev, phase
    """,
    "phased",
    "sessions",
)


def _phase_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return extended.phase_metrics(bars(spark, folder)).join(
        sessions(spark, folder).select(F.col("session").alias("session_date")), "session_date", "left_semi"
    )


@query(
    "phase_metrics",
    """SELECT symbol, session, phase, CAST(active_minutes AS BIGINT) AS active_minutes,
       round(dollar_volume, 4) AS dollar_volume, round(return_pct, 8) AS return_pct,
       round(gap_pct, 8) AS gap_pct, round(range_pct, 8) AS range_pct,
       round(volatility, 8) AS volatility, CAST(volume AS BIGINT) AS volume FROM phase_rows""",
    "phase_rows",
)
def phase_metrics(spark: SparkSession, folder: str) -> DataFrame:
    metrics = extended.with_gap(_phase_metrics(spark, folder), sessions(spark, folder))
    return metrics.select(
        "symbol", day_text("session_date").alias("session"), "phase", "active_minutes",
        F.round("dollar_volume", 4).alias("dollar_volume"),
        *[F.round(c, 8).alias(c) for c in ("return_pct", "gap_pct", "range_pct", "volatility")],
        "volume",
    )


sql_view(
    "evidence",
    """
    WITH keys AS (SELECT DISTINCT symbol, session, prev FROM phase_rows)
    SELECT k.symbol, k.session, k.prev, a.active_minutes AS pre_am, a.dollar_volume AS pre_dv,
           a.return_pct AS pre_ret, a.gap_pct AS pre_gap, a.range_pct AS pre_rng,
           a.volatility AS pre_vol, b.active_minutes AS post_am, b.dollar_volume AS post_dv,
           b.return_pct AS post_ret, b.range_pct AS post_rng, b.volatility AS post_vol
    FROM keys k
    LEFT JOIN (SELECT * FROM phase_rows WHERE phase = 'PRE_MARKET' AND gap_pct IS NOT NULL) a
      ON a.symbol = k.symbol AND a.session = k.session
    LEFT JOIN (SELECT * FROM phase_rows WHERE phase = 'POST_MARKET') b
      ON b.symbol = k.symbol AND b.session = k.prev
    """,
    "phase_rows",
)


def _evidence(spark: SparkSession, folder: str) -> DataFrame:
    return extended.session_evidence(_phase_metrics(spark, folder), sessions(spark, folder))


@query(
    "extended_scores",
    """
WITH cells AS (
  UNPIVOT (SELECT symbol, session, pre_am::DOUBLE AS pre_am, pre_dv, pre_ret, pre_gap, pre_rng,
                  pre_vol, post_am::DOUBLE AS post_am, post_dv, post_ret, post_rng, post_vol
           FROM evidence)
  ON COLUMNS(* EXCLUDE (symbol, session)) INTO NAME metric VALUE v),
ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY session, metric ORDER BY v) - 1 AS r FROM cells),
sized AS (SELECT *, max(r) OVER (PARTITION BY session, metric) AS top FROM ranked),
scored AS (
  SELECT symbol, session, metric LIKE 'pre%' AS pre,
         CASE WHEN top = 0 THEN 0.5 WHEN metric LIKE '%rng' OR metric LIKE '%_vol'
              THEN 1 - r / top::DOUBLE ELSE r / top::DOUBLE END AS s FROM sized),
agg AS (SELECT symbol, session, avg(s) FILTER (pre) AS p, avg(s) FILTER (NOT pre) AS q
        FROM scored GROUP BY ALL)
SELECT e.symbol, e.session, round(coalesce(p, 0.5), 8) AS premarket_score,
       round(coalesce(q, 0.5), 8) AS postmarket_score,
       round((coalesce(p, 0.5) + coalesce(q, 0.5)) / 2, 8) AS extended_score
FROM evidence e LEFT JOIN agg USING (symbol, session)
""",
    "evidence",
)
def extended_scores(spark: SparkSession, folder: str) -> DataFrame:
    return extended.extended_scores(_evidence(spark, folder)).select(
        "symbol", day_text("session_date").alias("session"),
        *[
            F.round(c, 8).alias(c)
            for c in ("premarket_score", "postmarket_score", "extended_score")
        ],
    )


@query(
    "extended_gates",
    """
SELECT symbol, session, CASE WHEN pre_am IS NULL THEN 'required pre-market evidence unavailable'
  ELSE array_to_string(list_filter([
    CASE WHEN pre_am < 4 THEN 'pre-market active minutes below limit' END,
    CASE WHEN pre_dv < 500000 THEN 'pre-market dollar volume below limit' END,
    CASE WHEN abs(pre_ret) > 0.02 THEN 'pre-market absolute return above limit' END,
    CASE WHEN abs(pre_gap) > 0.03 THEN 'pre-market absolute gap above limit' END,
    CASE WHEN pre_rng > 0.10 OR pre_vol > 0.05 THEN 'pre-market instability above limit' END,
    CASE WHEN post_am < 3 THEN 'prior post-market active minutes below limit' END,
    CASE WHEN post_dv < 500000 THEN 'prior post-market dollar volume below limit' END,
    CASE WHEN abs(post_ret) > 0.02 THEN 'prior post-market absolute return above limit' END,
    CASE WHEN post_rng > 0.10 OR post_vol > 0.05 THEN 'prior post-market instability above limit' END
  ], lambda x: x IS NOT NULL), '; ') END AS reasons
FROM evidence
""",
    "evidence",
)
def extended_gates(spark: SparkSession, folder: str) -> DataFrame:
    thresholds = ExtendedThresholds(
        min_pre_active_minutes=4, min_pre_dollar_volume=500_000, max_pre_abs_return=0.02,
        max_pre_abs_gap=0.03, max_pre_range=0.10, max_pre_volatility=0.05,
        min_post_active_minutes=3, min_post_dollar_volume=500_000, max_post_abs_return=0.02,
        max_post_range=0.10, max_post_volatility=0.05,
    )
    return _evidence(spark, folder).select(
        "symbol", day_text("session_date").alias("session"),
        F.concat_ws("; ", extended.extended_gate_reasons(thresholds)).alias("reasons"),
    )


# ---- outcomes -----------------------------------------------------------------------

OUTCOME_CTE = """
WITH path AS (
  SELECT p.*, b.start_us AS t, b.high AS h, b.low AS l, b.close AS c
  FROM plans p JOIN bars b USING (symbol, session) {where}),
trig AS (SELECT *, min(CASE WHEN t >= valid_us AND h >= entry {until} THEN t END)
                     OVER (PARTITION BY snapshot_id) AS trg FROM path),
touched AS (SELECT *, min(CASE WHEN t >= trg AND (l <= stop OR h >= target) THEN t END)
                        OVER (PARTITION BY snapshot_id) AS tch FROM trig),
agg AS (
  SELECT snapshot_id, symbol, session, any_value(entry) AS entry, any_value(stop) AS stop,
         any_value(target) AS target, any_value(quantity) AS q, any_value(valid_us) AS valid_us,
         any_value(trg) AS trg, any_value(tch) AS tch,
         coalesce(bool_or(t = trg AND l <= stop), FALSE) AS sb,
         coalesce(bool_or(t = tch AND l <= stop), FALSE) AS hs,
         coalesce(bool_or(t = tch AND h >= target), FALSE) AS ht,
         max(h) FILTER (t >= trg AND (tch IS NULL OR t <= tch)) AS hi,
         min(l) FILTER (t >= trg AND (tch IS NULL OR t <= tch)) AS lo,
         arg_max(c, t) AS lastc, max(t) AS lastt, arg_min(c, t) AS firstc,
         min(t) FILTER (t >= trg AND h >= target) AS target_us,
         min(t) FILTER (t >= trg AND l <= stop) AS stop_us,
         max(h) FILTER (trg IS NULL OR t >= trg) AS fav,
         min(l) FILTER (trg IS NULL OR t >= trg) AS adv
  FROM touched GROUP BY ALL),
out AS (
  SELECT *, CASE WHEN trg IS NULL THEN 'no_trigger' WHEN sb OR (hs AND ht) THEN 'ambiguous_same_bar'
                 WHEN hs THEN 'stop_before_target' WHEN ht THEN 'target_before_stop' ELSE 'eod' END AS outcome
  FROM agg),
res AS (
  SELECT *, CASE WHEN trg IS NULL OR sb THEN 0 ELSE greatest(0, hi - entry) END AS mfe,
         CASE WHEN trg IS NULL OR sb THEN 0 ELSE greatest(0, entry - lo) END AS mae,
         CASE outcome WHEN 'stop_before_target' THEN stop WHEN 'target_before_stop' THEN target
                      WHEN 'eod' THEN lastc END AS exit_price,
         CASE WHEN trg IS NULL THEN NULL WHEN sb THEN trg WHEN outcome = 'eod' THEN lastt ELSE tch END AS exit_us
  FROM out)
"""
BARRIER_SQL = OUTCOME_CTE.format(where="", until="AND t <= expires_us")
SHADOW_SQL = OUTCOME_CTE.format(where="WHERE b.start_us >= p.valid_us", until="")


@query(
    "barrier_outcomes",
    BARRIER_SQL
    + """SELECT snapshot_id, outcome, trg AS trigger_us, exit_us, round(exit_price, 6) AS exit_price,
         round(mfe, 6) AS mfe, round(mae, 6) AS mae FROM res""",
    "plans",
    "bars",
)
def barrier_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes.barrier_outcomes(plans(spark, folder), bars(spark, folder)).select(
        "snapshot_id", "outcome", us("trigger_at").alias("trigger_us"),
        us("exit_at").alias("exit_us"),
        *[F.round(c, 6).alias(c) for c in ("exit_price", "mfe", "mae")],
    )


PROFILE = ExecutionProfile(
    commission_per_order=0.5, slippage_bps=5, fx_rate=1.25, fx_fee_bps=10
)
sql_view(
    "shadow",
    SHADOW_SQL
    + """, val AS (
  SELECT *, CASE WHEN trg IS NOT NULL THEN (exit_price - entry) / entry END AS shadow_return,
         (entry * 0.0005::DOUBLE + exit_price * 0.0005::DOUBLE) * q + 1.0
           + (entry + exit_price) * q * 1.25::DOUBLE * 0.001::DOUBLE AS cost FROM res)
SELECT v.*, p.session AS plan_session, p.snapshot_id AS sid, p.symbol AS sym,
       CASE WHEN v.snapshot_id IS NULL THEN 'unavailable' ELSE 'complete' END AS status,
       (q * v.entry * shadow_return - cost) / (q * v.entry) AS net_return
FROM plans p LEFT JOIN val v ON p.snapshot_id = v.snapshot_id""",
    "plans",
    "bars",
)


def shadow_rows(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes.shadow_outcomes(plans(spark, folder), bars(spark, folder), PROFILE)


@query(
    "shadow_outcomes",
    """
SELECT sid AS snapshot_id, status, outcome, trg IS NOT NULL AND status = 'complete' AS triggered,
       coalesce(target_us IS NOT NULL, FALSE) AS target_hit, coalesce(stop_us IS NOT NULL, FALSE) AS stop_hit,
       round(fav, 6) AS max_favorable_price, round(adv, 6) AS max_adverse_price,
       round(mfe / entry, 8) AS mfe_pct, round(mae / entry, 8) AS mae_pct,
       CAST((trg - valid_us) / 1000000 AS DOUBLE) AS time_to_entry_seconds,
       round(shadow_return, 8) AS shadow_return, round(net_return, 8) AS net_return,
       round((lastc - coalesce(CASE WHEN trg IS NOT NULL THEN entry END, firstc))
             / coalesce(CASE WHEN trg IS NOT NULL THEN entry END, firstc), 8) AS eod_return
FROM shadow
""",
    "shadow",
)
def shadow_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    false = F.lit(False)
    return shadow_rows(spark, folder).select(
        "snapshot_id", "status", "outcome",
        F.coalesce("entry_triggered", false).alias("triggered"),
        F.coalesce("target_hit", false).alias("target_hit"),
        F.coalesce("stop_hit", false).alias("stop_hit"),
        *[F.round(c, 6).alias(c) for c in ("max_favorable_price", "max_adverse_price")],
        *[F.round(c, 8).alias(c) for c in ("mfe_pct", "mae_pct")],
        "time_to_entry_seconds",
        *[F.round(c, 8).alias(c) for c in ("shadow_return", "net_return", "eod_return")],
    )


# ---- rules of single quotes, phases and stored quotes ---------------------------------

@query(
    "quote_freshness",
    f"""
WITH q AS (SELECT event_id, received_us, received_us + (event_id % 11 - 1) * 60000000 AS decided_us FROM quotes_dense),
e AS (SELECT *, CAST({ET.format("received_us")} AS DATE) AS own, CAST({ET.format("decided_us")} AS DATE) AS theirs FROM q)
SELECT event_id, CASE WHEN own <> theirs THEN 'another session' WHEN decided_us < received_us THEN 'received after decision'
       WHEN decided_us - received_us > 300000000 THEN 'stale quote' WHEN decided_us % 86400000000 < 50400000000 THEN 'before decision time' END AS reason
FROM e
""",
    "quotes_dense",
)
def quote_freshness(spark: SparkSession, folder: str) -> DataFrame:
    """Each quote held against a decision a few minutes before or after it, none before 14:00 UTC."""
    minutes = (F.col("event_id") % 11 - 1).cast("long")
    frame = quotes_dense(spark, folder).withColumn("decided_at", F.timestamp_micros(F.unix_micros("received_at") + minutes * 60_000_000))
    opening = F.date_trunc("day", "decided_at") + F.expr("INTERVAL 14 HOURS")
    return frame.select("event_id", quality.freshness_reason(F.col("received_at"), F.col("decided_at"), opening).alias("reason"))


@query(
    "session_quotes",
    """SELECT symbol, event_id, received_us FROM quotes
       WHERE symbol = 'U7' AND session = (SELECT max(session) FROM quotes WHERE symbol = 'U7')""",
    "quotes",
)
def session_quotes(spark: SparkSession, folder: str) -> DataFrame:
    """One symbol's newest session, the symbol written as a user might."""
    rows = quotes(spark, folder)
    newest = rows.filter("symbol = 'U7'").agg(F.max("session_date")).scalar()
    return quality.session_quotes(rows, " u7 ", newest).select("symbol", "event_id", us("received_at").alias("received_us"))


@query(
    "phase_rows",
    """SELECT symbol, session, CAST(count_if(phase = 'PRE_MARKET') AS BIGINT) AS pre_market_rows, CAST(count_if(phase = 'REGULAR') AS BIGINT) AS regular_rows,
              CAST(count_if(phase = 'POST_MARKET') AS BIGINT) AS post_market_rows, CAST(count_if(phase IS NULL) AS BIGINT) AS outside_rows,
              CAST(count_if(start_us % 7200000000 = 0) AS BIGINT) AS wrong_length_rows
       FROM phased GROUP BY symbol, session""",
    "phased",
)
def phase_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly bars per phase; those of even hours claim a second too many."""
    b = bars(spark, folder)
    late = F.timestamp_micros(F.unix_micros("end") + F.when(F.pmod(F.unix_micros("start"), F.lit(7_200_000_000)) == 0, 1_000_000).otherwise(0))
    return coverage.phase_rows(b.withColumn("end", late), 60).select(
        "symbol", day_text("session_date").alias("session"), "pre_market_rows", "regular_rows", "post_market_rows", "outside_rows", "wrong_length_rows",
    )


@query(
    "quotes_insert_absent",
    """SELECT symbol, received_us // 3600000000 * 3600000000 AS hour_us, event_id FROM quotes_dense
       QUALIFY row_number() OVER (PARTITION BY symbol, received_us // 3600000000 ORDER BY event_id % 3, event_id) = 1""",
    "quotes_dense",
)
def quotes_insert_absent(spark: SparkSession, folder: str) -> DataFrame:
    """One quote a symbol and hour, inserted where absent in three batches and read back."""
    from tidemark.shared import shared_folder
    from tidemark.sources import versions

    hour = F.date_trunc("hour", "received_at")
    rows = quotes_dense(spark, folder).select("symbol", hour.alias("hour"), "event_id")
    root = shared_folder(spark)
    for part in range(3):
        versions.insert_absent(rows.filter(F.col("event_id") % 3 == part), root, ["symbol", "hour"], ["event_id"], along="hour")
    return versions.read_inserted(spark, root, rows.schema).select("symbol", us("hour").alias("hour_us"), "event_id")

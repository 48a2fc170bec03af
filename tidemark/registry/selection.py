"""Universe, cohort, gate, plan and ranking queries over the part cross-section."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scores
from tidemark.operators import selection, universe
from tidemark.policies import (
    CohortPolicy,
    FinalistPolicy,
    RankingWeights,
    RiskPolicy,
    StrategyPolicy,
    UniversePolicy,
)
from tidemark.registry.core import query, sql_view, table
from tidemark.registry.views import candidates, candidates_day, day_text

UNIVERSE = UniversePolicy(target=120)
STRATEGY = StrategyPolicy(max_spread_pct=0.02)
CASH = 105.0

SCORE_SQL = """round(0.45 * least(1, log10(greatest(1.0, median_dollar_volume)) / 9.0)
  + 0.25 * (1 - least(1.0, spread_pct / 0.02::DOUBLE)) + 0.15 * least(1.0, volatility / 0.05::DOUBLE)
  + 0.15 * coverage_ratio, 10)"""
sql_view(
    "judged",
    f"""
    SELECT *, CASE WHEN NOT active THEN 'inactive security'
      WHEN NOT provider_resolvable THEN 'live provider cannot resolve symbol'
      WHEN asset_type NOT IN ('common_stock', 'approved_etf') THEN 'unsupported asset type'
      WHEN NOT corporate_action_ok THEN 'unresolved corporate action'
      WHEN price > 100 THEN 'price exceeds cash-only universe limit'
      WHEN median_dollar_volume <= 0 THEN 'insufficient liquidity history'
      WHEN spread_pct > 0.02::DOUBLE THEN 'spread quality below universe limit'
      WHEN coverage_ratio < 0.9::DOUBLE THEN 'historical coverage below universe limit'
      WHEN is_ipo AND listing_sessions < 20 THEN 'IPO seasoning period incomplete' END AS why,
      {SCORE_SQL} AS raw_score
    FROM candidates
    """,
    "candidates",
)


@query(
    "universe_score",
    "SELECT symbol, why AS reason, CASE WHEN why IS NULL THEN raw_score END AS score FROM judged",
    "judged",
)
def universe_score(spark: SparkSession, folder: str) -> DataFrame:
    df = candidates(spark, folder).withColumn("reason", universe.eligibility_reason(UNIVERSE))
    return df.select(
        "symbol", "reason",
        F.when(F.col("reason").isNull(), scores.universe_score(UNIVERSE)).alias("score"),
    )


sql_view(
    "selected",
    """
    WITH e AS (SELECT * FROM judged WHERE why IS NULL),
    s AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY raw_score DESC, symbol, security_id) AS sr
          FROM e),
    m AS (SELECT symbol, row_number() OVER (ORDER BY raw_score DESC, symbol, security_id) AS rank
          FROM s WHERE sector = 'UNKNOWN' OR sr <= 30 QUALIFY rank <= 120),
    o AS (SELECT *, row_number() OVER (ORDER BY raw_score DESC, symbol, security_id) AS pos FROM e),
    cut AS (SELECT CASE WHEN count(*) >= 120 THEN max(pos) END AS cutpos FROM o JOIN m USING (symbol))
    SELECT j.*, m.rank, CASE WHEN j.why IS NOT NULL THEN j.why
        WHEN m.rank IS NOT NULL THEN 'selected by monthly universe score'
        WHEN o.pos > (SELECT cutpos FROM cut) THEN 'below active-universe cutoff'
        ELSE 'sector concentration limit' END AS reason
    FROM judged j LEFT JOIN o USING (symbol) LEFT JOIN m USING (symbol)
    """,
    "judged",
)


@query(
    "universe_select",
    """SELECT symbol, sector, rank IS NOT NULL AS included, CAST(rank AS INTEGER) AS rank, reason
       FROM selected""",
    "selected",
)
def universe_select(spark: SparkSession, folder: str) -> DataFrame:
    return universe.select_universe(candidates(spark, folder), UNIVERSE).select(
        "symbol", "sector", "included", "rank", "reason"
    )


@query(
    "universe_digest",
    """
WITH h AS (SELECT reason, sha256(concat_ws('|', symbol, security_id, sector, reason)) AS h FROM selected),
l AS (SELECT reason, count(*) AS n,
             sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS a, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS b,
             sum(CAST('0x' || substr(h, 31, 15) AS BIGINT)) AS c, sum(CAST('0x' || substr(h, 46, 15) AS BIGINT)) AS d
      FROM h GROUP BY reason)
SELECT reason, CAST(n AS BIGINT) AS rows, sha256(concat_ws(':', n, a, b, c, d)) AS digest,
       'US-2024-03-' || substr(sha256(concat_ws(':', n, a, b, c, d)), 1, 12) AS universe_id FROM l
""",
    "selected",
)
def universe_digest(spark: SparkSession, folder: str) -> DataFrame:
    rows = universe.select_universe(candidates(spark, folder), UNIVERSE)
    digests = universe.content_digest(
        rows, ["symbol", "security_id", "sector", "reason"], by=["reason"]
    )
    return digests.withColumn(
        "universe_id", universe.versioned_id("US", F.lit("2024-03"), F.col("digest"))
    )


sql_view(
    "daily_bars",
    """
    SELECT 'P' || l_partkey AS symbol, CAST(l_shipdate AS DATE) AS day, max(u) AS high, min(u) AS low,
           arg_max(u, l_orderkey * 10 + l_linenumber) AS close, sum(l_quantity) AS volume
    FROM (SELECT *, l_extendedprice / l_quantity AS u FROM lineitem) GROUP BY ALL
    """,
)


def daily_bars(spark: SparkSession, folder: str) -> DataFrame:
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    line = table(spark, folder, "lineitem").withColumn("u", unit)
    return line.groupBy(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("symbol"),
        F.col("l_shipdate").cast("date").alias("session_date"),
    ).agg(
        F.max("u").alias("high"),
        F.min("u").alias("low"),
        F.max_by("u", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("close"),
        F.sum("l_quantity").alias("volume"),
    )


@query(
    "bar_metrics",
    """
WITH days AS (SELECT DISTINCT day FROM daily_bars),
b AS (SELECT * FROM daily_bars WHERE day IN (SELECT day FROM days) AND close > 0 AND volume > 0 AND low > 0)
SELECT symbol, round(arg_max(close, day), 9) AS last_close, CAST(count(DISTINCT day) AS BIGINT) AS sessions,
       round(median(close * volume), 4) AS median_dollar_volume,
       round(median((high - low) / close), 8) AS volatility,
       round(least(1, count(DISTINCT day) / (SELECT count(*) FROM days)), 8) AS coverage_ratio
FROM b GROUP BY symbol
""",
    "daily_bars",
)
def bar_metrics(spark: SparkSession, folder: str) -> DataFrame:
    bars = daily_bars(spark, folder)
    days = bars.select("session_date").distinct()
    return universe.bar_metrics(bars, days).select(
        "symbol",
        F.round("last_close", 9).alias("last_close"),
        "sessions",
        F.round("median_dollar_volume", 4).alias("median_dollar_volume"),
        F.round("volatility", 8).alias("volatility"),
        F.round("coverage_ratio", 8).alias("coverage_ratio"),
    )


# ---- slowly changing membership -----------------------------------------------------

sql_view(
    "snapshots",
    """
    SELECT 'US-' || strftime(q, '%Y-%m') AS universe_id, q AS effective_from, 'cust:' || o_custkey AS security_id,
           CASE WHEN o_custkey % 11 = 0 AND quarter(q) % 2 = 1 THEN 'X' ELSE 'C' END || o_custkey AS symbol
    FROM (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q, o_custkey, sum(o_totalprice) AS total
          FROM orders GROUP BY ALL) WHERE total >= 100000
    """,
)


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    quarter = F.to_date(F.date_trunc("quarter", "o_orderdate"))
    spent = (
        table(spark, folder, "orders")
        .groupBy(quarter.alias("effective_from"), "o_custkey")
        .agg(F.sum("o_totalprice").alias("total"))
        .filter("total >= 100000")
    )
    key = F.col("o_custkey").cast("string")
    renamed = (F.col("o_custkey") % 11 == 0) & (F.quarter("effective_from") % 2 == 1)
    return spent.select(
        F.concat(F.lit("US-"), F.date_format("effective_from", "yyyy-MM")).alias("universe_id"),
        "effective_from",
        F.concat(F.lit("cust:"), key).alias("security_id"),
        F.concat(F.when(renamed, "X").otherwise("C"), key).alias("symbol"),
    )


sql_view(
    "memberships",
    """
    SELECT s.*, n.effective_to FROM snapshots s JOIN (
      SELECT effective_from, lead(effective_from) OVER (ORDER BY effective_from) AS effective_to
      FROM (SELECT DISTINCT effective_from FROM snapshots)) n USING (effective_from)
    """,
    "snapshots",
)


@query(
    "scd2_membership",
    """SELECT universe_id, security_id, symbol, strftime(effective_from, '%Y-%m-%d') AS effective_from,
              strftime(effective_to, '%Y-%m-%d') AS effective_to FROM memberships""",
    "memberships",
)
def scd2_membership(spark: SparkSession, folder: str) -> DataFrame:
    return universe.memberships(snapshots(spark, folder)).select(
        "universe_id", "security_id", "symbol", day_text("effective_from").alias("effective_from"),
        day_text("effective_to").alias("effective_to"),
    )


@query(
    "membership_asof",
    """SELECT security_id, symbol FROM memberships WHERE effective_from <= DATE '1997-05-20'
         AND (effective_to IS NULL OR effective_to > DATE '1997-05-20')""",
    "memberships",
)
def membership_asof(spark: SparkSession, folder: str) -> DataFrame:
    members = universe.memberships(snapshots(spark, folder))
    return universe.membership_as_of(members, F.lit("1997-05-20").cast("date")).select(
        "security_id", "symbol"
    )


@query(
    "symbol_history",
    """
WITH c AS (SELECT *, lag(symbol) OVER (PARTITION BY security_id ORDER BY effective_from) AS before FROM snapshots),
h AS (SELECT * FROM c WHERE before IS NULL OR before <> symbol),
r AS (SELECT security_id, symbol, effective_from,
             lead(effective_from) OVER (PARTITION BY security_id ORDER BY effective_from) AS effective_to,
             CASE WHEN before IS NULL THEN 'snapshot' ELSE 'ticker_change' END AS reason FROM h),
d AS (SELECT DISTINCT security_id FROM snapshots WHERE CAST(substr(security_id, 6) AS BIGINT) % 50 = 7)
SELECT security_id, symbol, strftime(effective_from, '%Y-%m-%d') AS effective_from,
       CASE WHEN effective_to IS NULL AND d.security_id IS NOT NULL THEN '2005-01-03'
            ELSE strftime(effective_to, '%Y-%m-%d') END AS effective_to,
       CASE WHEN effective_to IS NULL AND d.security_id IS NOT NULL THEN 'delisted' ELSE reason END AS reason
FROM r LEFT JOIN d USING (security_id)
""",
    "snapshots",
)
def symbol_history(spark: SparkSession, folder: str) -> DataFrame:
    snaps = snapshots(spark, folder)
    gone = (
        snaps.filter(F.substring("security_id", 6, 20).cast("long") % 50 == 7)
        .select("security_id")
        .distinct()
        .withColumns(
            {"effective_on": F.lit("2005-01-03").cast("date"), "reason": F.lit("delisted")}
        )
    )
    return universe.symbol_history(snaps, gone).select(
        "security_id", "symbol", day_text("effective_from").alias("effective_from"),
        day_text("effective_to").alias("effective_to"), "reason",
    )


@query(
    "new_members",
    """
SELECT s.universe_id, s.security_id FROM snapshots s
JOIN (SELECT effective_from, lag(effective_from) OVER (ORDER BY effective_from) AS prev
      FROM (SELECT DISTINCT effective_from FROM snapshots)) n USING (effective_from)
LEFT JOIN snapshots p ON p.effective_from = n.prev AND p.security_id = s.security_id
WHERE p.security_id IS NULL
""",
    "snapshots",
)
def new_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members of each snapshot that the previous one lacked."""
    from tidemark.operators.sets import added_since_previous

    return added_since_previous(snapshots(spark, folder)).select("universe_id", "security_id")


# ---- scan and cohort ----------------------------------------------------------------

sql_view(
    "scan",
    """
    SELECT symbol, partkey, price AS last_trade_price, price * (1 - spread_pct / 2) AS bid_price,
           price * (1 + spread_pct / 2) AS ask_price, (partkey * 131) % 9000 AS volume,
           price * (0.95::DOUBLE + (partkey % 11) / 100.0::DOUBLE) AS open_price, price * 1.03 AS high_price,
           price * (0.90::DOUBLE + (partkey % 9) / 100.0::DOUBLE) AS low_price,
           partkey % 31 <> 0 AS is_trade_eligible,
           CASE WHEN partkey % 31 = 0 AND partkey % 2 = 0 THEN 'HALTED' END AS invalid_reason,
           CASE WHEN partkey % 6 = 0 THEN NULL ELSE ((partkey * 17) % 400000)::DOUBLE END AS average_daily_volume,
           CASE WHEN partkey % 7 = 0 THEN NULL ELSE price * (0.96::DOUBLE + (partkey % 8) / 100.0::DOUBLE) END AS previous_close,
           CASE WHEN partkey % 8 = 0 THEN NULL ELSE (partkey * 29) % 8000 END AS prior_volume,
           CASE WHEN partkey % 5 = 0 THEN NULL ELSE 0.01::DOUBLE END AS benchmark_return,
           CASE WHEN partkey % 9 = 0 THEN NULL ELSE (partkey % 4) / 100.0::DOUBLE END AS sector_return,
           CASE WHEN partkey % 10 = 0 THEN NULL ELSE ((partkey * 7) % 50000)::DOUBLE END AS premarket_volume,
           CASE WHEN partkey % 12 < 3 THEN NULL ELSE (partkey % 12 - 6) / 100.0::DOUBLE END AS premarket_gap,
           CASE WHEN partkey % 13 < 4 THEN NULL ELSE (partkey % 13) / 200.0::DOUBLE END AS premarket_range
    FROM candidates
    """,
    "candidates",
)


def scan_quotes(spark: SparkSession, folder: str) -> DataFrame:
    df = candidates(spark, folder)
    key, price = F.col("partkey"), F.col("price")

    def unless(condition, value):
        return F.when(~condition, value)

    def part(modulus: int, divisor: float):
        return (key % modulus) / F.lit(divisor)

    return df.select(
        "symbol",
        "partkey",
        price.alias("last_trade_price"),
        (price * (1 - F.col("spread_pct") / 2)).alias("bid_price"),
        (price * (1 + F.col("spread_pct") / 2)).alias("ask_price"),
        ((key * 131) % 9000).alias("volume"),
        (price * (F.lit(0.95) + part(11, 100.0))).alias("open_price"),
        (price * 1.03).alias("high_price"),
        (price * (F.lit(0.90) + part(9, 100.0))).alias("low_price"),
        (key % 31 != 0).alias("is_trade_eligible"),
        F.when((key % 31 == 0) & (key % 2 == 0), "HALTED").alias("invalid_reason"),
        unless(key % 6 == 0, ((key * 17) % 400000).cast("double")).alias("average_daily_volume"),
        unless(key % 7 == 0, price * (F.lit(0.96) + part(8, 100.0))).alias("previous_close"),
        unless(key % 8 == 0, (key * 29) % 8000).alias("prior_volume"),
        unless(key % 5 == 0, F.lit(0.01)).alias("benchmark_return"),
        unless(key % 9 == 0, part(4, 100.0)).alias("sector_return"),
        unless(key % 10 == 0, ((key * 7) % 50000).cast("double")).alias("premarket_volume"),
        unless(key % 12 < 3, (key % 12 - 6) / F.lit(100.0)).alias("premarket_gap"),
        unless(key % 13 < 4, part(13, 200.0)).alias("premarket_range"),
    ).withColumns(scores.scan_metrics())


def _c(expr: str) -> str:
    return f"least(1.0, greatest(0.0, {expr}))"


sql_view(
    "scan_scores",
    f"""
    WITH own AS (SELECT *, last_trade_price / nullif(previous_close, 0) - 1 AS own FROM scan),
    m AS (SELECT *, volume / nullif(average_daily_volume * (5 / 390::DOUBLE), 0) AS rvol,
                 greatest(0.0, volume - prior_volume) / greatest(1.0, prior_volume) AS accel0,
                 own - benchmark_return AS mr, own - sector_return AS sr FROM own),
    r AS (SELECT *, CASE WHEN prior_volume IS NOT NULL THEN accel0 END AS accel,
                 CASE WHEN mr IS NULL AND sr IS NULL THEN NULL
                      ELSE (coalesce(mr, 0) + coalesce(sr, 0)) / ((mr IS NOT NULL)::INT + (sr IS NOT NULL)::INT) END AS rs,
                 coalesce(own, last_trade_price / open_price - 1) AS gap,
                 CASE WHEN premarket_volume IS NOT NULL THEN {_c("log10(greatest(1.0, premarket_volume)) / 8.0")} END AS pv FROM m),
    p AS (SELECT *, CASE WHEN premarket_gap IS NOT NULL
                         THEN coalesce(nullif(pv, 0), 0.5) * 0.5 + {_c("greatest(0.0, premarket_gap) / 0.05::DOUBLE")} * 0.5
                         ELSE pv END AS pg FROM r),
    q AS (SELECT *, CASE WHEN premarket_range IS NOT NULL
                         THEN coalesce(nullif(pg, 0), 0.5) * 0.75 + {_c("premarket_range / 0.05::DOUBLE")} * 0.25
                         ELSE pg END AS pr FROM p)
    SELECT symbol, is_trade_eligible AS valid, invalid_reason,
           CASE WHEN is_trade_eligible THEN {_c(f'''round(
             0.20 * {_c("log10(greatest(1.0, last_trade_price * volume)) / 9.0")}
             + 0.20 * {_c("coalesce(rvol, 1.0) / 4")} + 0.10 * {_c("coalesce(accel, 1.0) / 0.03::DOUBLE")}
             + 0.12 * {_c("greatest(0.0, gap) / 0.05::DOUBLE")} - 0.08 * {_c("greatest(0.0, -gap) / 0.05::DOUBLE")}
             + 0.15 * {_c("greatest(0.0, high_price - low_price) / open_price / 0.05::DOUBLE")}
             + 0.15 * (1 - {_c("(ask_price - bid_price) / ((bid_price + ask_price) / 2) / 0.02::DOUBLE")})
             + 0.05 * {_c("0.5 + coalesce(rs, 0) * 10")} + 0.08 * coalesce(pr, 0.5), 10)''')} ELSE 0 END AS score
    FROM q
    """,
    "scan",
)


def _scores(spark: SparkSession, folder: str) -> DataFrame:
    return selection.score_scan(scan_quotes(spark, folder), 0.02)


@query(
    "broad_scan",
    """SELECT symbol, valid, score,
              CASE WHEN valid THEN 'passed broad scan gates' ELSE coalesce(invalid_reason, 'invalid scan quote') END AS reason
       FROM scan_scores""",
    "scan_scores",
)
def broad_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _scores(spark, folder).select(
        "symbol", "valid", "score", "reason"
    )


COHORT = CohortPolicy()


@query(
    "cohort_20_5_5",
    """
WITH r AS (SELECT symbol, row_number() OVER (ORDER BY round(score, 10) DESC, symbol) AS rn FROM scan_scores WHERE valid),
t AS (SELECT * FROM r WHERE rn <= 25),
d AS (SELECT * FROM (SELECT symbol, 25 + row_number() OVER (ORDER BY sha256('2024-03-04:' || symbol)) AS rn
                     FROM (SELECT symbol FROM r WHERE rn > 25)) WHERE rn <= 30)
SELECT symbol, CAST(rn AS INTEGER) AS rank, CASE WHEN rn <= 20 THEN 'core' ELSE 'boundary' END AS bucket,
       CASE WHEN rn <= 20 THEN 'top-ranked valid symbol' ELSE 'valid symbol just below core cutoff' END AS reason FROM t
UNION ALL SELECT symbol, CAST(rn AS INTEGER), 'diversity', 'deterministic diversity sample' FROM d
""",
    "scan_scores",
)
def cohort_20_5_5(spark: SparkSession, folder: str) -> DataFrame:
    scored = _scores(spark, folder).select(
        F.lit("2024-03-04").alias("session"), "symbol", F.col("score").alias("rank_score"), "valid"
    )
    return selection.build_cohort(scored, COHORT).select("symbol", "rank", "bucket", "reason")


# ---- gates, plans, ranking ----------------------------------------------------------

sql_view(
    "evaluated",
    """
    WITH g AS (SELECT *, greatest(opening_range_high, vwap) * 1.001::DOUBLE AS e, least(opening_range_high, vwap) * 0.999::DOUBLE AS s
               FROM candidates_day),
    q AS (SELECT *, CAST(CASE WHEN e > s THEN floor(least(105 / e, 1.0 / (e - s))) ELSE 0 END AS BIGINT) AS qty,
      CASE WHEN NOT fresh THEN 'stale market data' WHEN delayed THEN 'delayed market data' WHEN halted THEN 'trading halt'
        WHEN least(price, bid, ask, vwap, opening_range_high) <= 0 THEN 'non-positive market price'
        WHEN ask < bid THEN 'crossed market' WHEN (ask - bid) / ((ask + bid) / 2) > 0.02::DOUBLE THEN 'spread exceeds limit'
        WHEN volatility > 0.05::DOUBLE THEN 'volatility exceeds limit' WHEN rvol < 1 THEN 'relative volume below limit'
        WHEN volume < 1000 THEN 'liquidity below limit' WHEN e > 105 THEN 'entry does not fit cash-only account' END AS gate
      FROM g),
    r AS (SELECT *, CASE WHEN gate IS NOT NULL THEN gate WHEN e <= s OR qty < 1
                    THEN 'invalid risk geometry or insufficient cash/risk budget' ELSE 'passed hard gates' END AS reason,
                 (price / vwap - 1) * 100 + (rvol - 1) AS raw FROM q),
    t AS (SELECT *, reason = 'passed hard gates' AS eligible,
                 round((0.5 + raw / (2 * (1 + abs(raw)))) * 0.8 + extended_score * 0.2, 10) AS tech FROM r)
    SELECT *, CASE WHEN eligible THEN
        least(1, greatest(0, tech)) * (0.5 + CASE WHEN news_score IS NULL THEN 0.2 ELSE 0 END
          + CASE WHEN social_score IS NULL THEN 0.05 ELSE 0 END + CASE WHEN fundamental_score IS NULL THEN 0.05 ELSE 0 END)
        + market_score * 0.2 + coalesce(news_score, 0) * 0.2 + coalesce(social_score, 0) * 0.05
        + coalesce(fundamental_score, 0) * 0.05 END AS rank_score
    FROM t
    """,
    "candidates_day",
)


def evaluated(spark: SparkSession, folder: str) -> DataFrame:
    return selection.evaluate_candidates(
        candidates_day(spark, folder), cash_usd=CASH, policy=STRATEGY
    )


@query("hard_gates", "SELECT symbol, eligible, reason FROM evaluated", "evaluated")
def hard_gates(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder).select("symbol", "eligible", "reason")


@query(
    "trade_plans",
    """SELECT symbol, round(e, 6) AS entry, round(s, 6) AS stop, round(e + (e - s) * 2, 6) AS target, qty AS quantity,
              CASE WHEN price >= e THEN 'ENTRY_VALID' ELSE 'WAIT' END AS plan_status
       FROM evaluated WHERE eligible""",
    "evaluated",
)
def trade_plans(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder).filter("eligible").select(
        "symbol", *[F.round(c, 6).alias(c) for c in ("entry", "stop", "target")], "quantity",
        "plan_status",
    )


@query(
    "technical_score",
    "SELECT symbol, tech AS technical_score FROM evaluated WHERE eligible",
    "evaluated",
)
def technical_score(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder).filter("eligible").select(
        "symbol", "technical_score"
    )


@query(
    "multi_veto",
    """
WITH v AS (SELECT *, list_filter([
    CASE WHEN NOT fresh OR delayed THEN 'market data is not trustworthy' END,
    CASE WHEN halted THEN 'symbol is halted' END,
    CASE WHEN (ask - bid) / ((ask + bid) / 2) > 0.01::DOUBLE THEN 'spread unavailable or above limit' END,
    CASE WHEN volatility > 0.08::DOUBLE THEN 'volatility above limit' END,
    CASE WHEN volume < 2000 OR rvol < 1 THEN 'liquidity/relative volume below limit' END,
    CASE WHEN price > 105 THEN 'price does not fit current cash' END], lambda x: x IS NOT NULL) AS vetoes,
    greatest(vwap, opening_range_low) AS s FROM candidates_day),
q AS (SELECT *, CASE WHEN price > s THEN floor(least(105 / price, 1.0 / (price - s))) ELSE 0 END AS qty FROM v),
r AS (SELECT *, CASE WHEN len(vetoes) > 0 THEN array_to_string(vetoes, '; ')
        WHEN NOT (price > vwap AND price >= opening_range_high) THEN 'opening-range/VWAP trigger not valid'
        WHEN price - s <= 0 THEN 'non-positive stop distance' WHEN qty < 1 THEN 'risk/cash sizing yields zero shares'
        ELSE 'ORB/VWAP continuation valid' END AS reasons FROM q)
SELECT symbol, reasons, CASE WHEN reasons = 'ORB/VWAP continuation valid'
         THEN round(least(1, greatest(0, (rvol - 1) / 3)), 8) ELSE 0 END AS score,
       CASE WHEN reasons = 'ORB/VWAP continuation valid' THEN round(qty * (price - s), 6) END AS max_loss
FROM r
""",
    "candidates_day",
)
def multi_veto(spark: SparkSession, folder: str) -> DataFrame:
    out = selection.multi_veto(
        candidates_day(spark, folder), cash_usd=CASH, policy=RiskPolicy(min_volume=2000)
    )
    return out.select(
        "symbol", F.concat_ws("; ", "reasons").alias("reasons"), F.round("score", 8).alias("score"),
        F.round("max_loss", 6).alias("max_loss"),
    )


WEIGHTS = RankingWeights()


@query(
    "rank_all",
    """SELECT symbol, eligible, round(rank_score, 8) AS rank_score,
              CAST(row_number() OVER (ORDER BY eligible DESC, round(rank_score, 12) DESC NULLS LAST, symbol) AS INTEGER) AS rank
       FROM evaluated""",
    "evaluated",
)
def rank_all(spark: SparkSession, folder: str) -> DataFrame:
    df = evaluated(spark, folder)
    scored = selection.with_rank_score(df, WEIGHTS).withColumn(
        "rank_score", F.round("rank_score", 12)
    )
    from tidemark.operators.ordering import position

    return position(scored, ["session"], selection.rank_order(), along=selection.rank_along(), name="rank").select(
        "symbol", "eligible", F.round("rank_score", 8).alias("rank_score"), "rank"
    )


@query(
    "finalists",
    """
SELECT symbol, CAST(rn AS INTEGER) AS final_rank, rn = 1 AS primary, round(rank_score, 8) AS rank_score
FROM (SELECT *, row_number() OVER (ORDER BY rank_score DESC, symbol) AS rn FROM evaluated
      WHERE eligible AND rank_score >= 0.5) WHERE rn <= 5
""",
    "evaluated",
)
def finalists(spark: SparkSession, folder: str) -> DataFrame:
    scored = selection.with_rank_score(evaluated(spark, folder), WEIGHTS)
    return selection.finalists(scored, FinalistPolicy()).select(
        "symbol", "final_rank", "primary", F.round("rank_score", 8).alias("rank_score")
    )


@query(
    "shortlist",
    """SELECT symbol, CAST(row_number() OVER (ORDER BY rank_score DESC, symbol) AS INTEGER) AS rank
       FROM evaluated WHERE eligible QUALIFY rank <= 3""",
    "evaluated",
)
def shortlist(spark: SparkSession, folder: str) -> DataFrame:
    return selection.shortlist(evaluated(spark, folder), WEIGHTS, 3).select("symbol", "rank")


@query(
    "weight_ablation",
    """
WITH v AS (SELECT * FROM (VALUES ('baseline', 0.5, 0.2, 0.05, 0.05), ('no_news', 0.7, 0.0, 0.05, 0.05),
             ('no_social', 0.55, 0.2, 0.0, 0.05), ('no_fundamentals', 0.55, 0.2, 0.05, 0.0)) t(variant, wt, wn, ws, wf)),
s AS (SELECT variant, symbol, eligible, CASE WHEN eligible THEN
        least(1, greatest(0, tech)) * (wt::DOUBLE + CASE WHEN news_score IS NULL THEN wn::DOUBLE ELSE 0 END
          + CASE WHEN social_score IS NULL THEN ws::DOUBLE ELSE 0 END + CASE WHEN fundamental_score IS NULL THEN wf::DOUBLE ELSE 0 END)
        + market_score * 0.2::DOUBLE + coalesce(news_score, 0) * wn::DOUBLE + coalesce(social_score, 0) * ws::DOUBLE
        + coalesce(fundamental_score, 0) * wf::DOUBLE END AS score FROM evaluated, v)
SELECT variant, symbol, CAST(row_number() OVER (PARTITION BY variant ORDER BY eligible DESC, score DESC NULLS LAST, symbol) AS INTEGER) AS rank
FROM s
""",
    "evaluated",
)
def weight_ablation(spark: SparkSession, folder: str) -> DataFrame:
    return selection.weight_ablation(evaluated(spark, folder), WEIGHTS).select(
        "variant", "symbol", "rank"
    )


@query(
    "selection_explanations",
    """
WITH r AS (SELECT *, row_number() OVER (ORDER BY rank_score DESC, symbol) AS fr FROM evaluated WHERE eligible),
f AS (SELECT *, fr <= 5 AND rank_score >= 0.5 AS finalist FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY finalist ORDER BY fr) AS rn FROM f)
SELECT symbol, CAST(fr AS INTEGER) AS final_rank,
       CASE WHEN fr = 1 THEN 'PRIMARY' WHEN finalist THEN 'FINALIST' ELSE 'CONTROL' END AS role,
       round(0.5::DOUBLE + CASE WHEN news_score IS NULL THEN 0.2 ELSE 0 END + CASE WHEN social_score IS NULL THEN 0.05 ELSE 0 END
         + CASE WHEN fundamental_score IS NULL THEN 0.05 ELSE 0 END, 8) AS technical_weight
FROM k WHERE finalist OR rn <= 3
""",
    "evaluated",
)
def selection_explanations(spark: SparkSession, folder: str) -> DataFrame:
    scored = selection.with_rank_score(evaluated(spark, folder), WEIGHTS)
    best = selection.finalists(scored, FinalistPolicy()).select("session", "symbol", "primary")
    ranked = scored.join(best, ["session", "symbol"], "left").withColumns(
        {
            "finalist": F.col("primary").isNotNull(),
            "primary": F.coalesce("primary", F.lit(False)),
            "decision_price": F.col("price"),
        }
    )
    weights = scores.effective_weights(WEIGHTS, selection.component_columns())
    return selection.selection_explanations(ranked).select(
        "symbol", "final_rank", "role", F.round(weights["technical"], 8).alias("technical_weight")
    )

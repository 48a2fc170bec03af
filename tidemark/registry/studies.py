"""Research queries: regimes, ablations, activation, model evidence, lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import model, research
from tidemark.operators.outcomes import outcome_return
from tidemark.operators.scaling import settle
from tidemark.policies import ModelWindows
from tidemark.registry.core import query, sql_view, table
from tidemark.registry.markets import shadow_rows
from tidemark.registry.views import day_text, us

sql_view(
    "decisions",
    """
    SELECT 'P' || k AS symbol, 'R' || n AS snapshot_id, strftime(d, '%Y-%m-%d') AS session,
           strftime(d, '%Y-%m') AS month, k, n, (k + n) % 3 <> 0 AS eligible, k % 7 <> 0 AS has_plan,
           (k * 31 + n * 17) % 101 / 100.0::DOUBLE AS technical_score, (k * 7 + n) % 21 / 20.0::DOUBLE AS market_score,
           CASE WHEN k % 3 = 1 THEN NULL ELSE (k % 13) / 12.0::DOUBLE END AS news_score,
           CASE WHEN k % 4 = 1 THEN NULL ELSE (k % 17) / 16.0::DOUBLE END AS social_score,
           CASE WHEN k % 5 = 1 THEN NULL ELSE (k % 19) / 18.0::DOUBLE END AS fundamental_score,
           (k * 11 + n) % 41 / 40.0::DOUBLE AS volatility_score, ((k * 5 + n) % 81 - 40) / 1000.0::DOUBLE AS gap_pct,
           (k % 30) / 10.0::DOUBLE AS rvol, CASE WHEN k % 29 = 0 THEN NULL ELSE (k % 25) / 2000.0::DOUBLE END AS spread_pct,
           (k * 3 + n) % 31 / 30.0::DOUBLE AS momentum_score, (k * 13) % 37 / 36.0::DOUBLE AS sector_score,
           CAST((k % 23 = 0) AS INTEGER) AS earnings_count, k % 4 AS filing_count, k % 3 AS news_count, k % 2 AS macro_count,
           k % 6 <> 0 AS has_premarket, k % 8 <> 0 AS has_postmarket,
           k % 30 = 4 + n % 3 AS primary, k % 30 = 4 + n % 2 AS regular_only_primary
    FROM (SELECT p_partkey AS k, p_partkey // 30 AS n, TIMESTAMP '2024-01-01' + to_days(CAST(p_partkey // 30 AS INTEGER)) AS d FROM part)
    """,
)
sql_view(
    "results",
    """
    SELECT symbol, snapshot_id, session, month, k, n,
           CASE WHEN k % 17 = 0 THEN 'unavailable' ELSE 'complete' END AS status,
           CASE WHEN k % 19 = 0 THEN 'UNSPECIFIED' ELSE 'BAR_ONLY' END AS fidelity,
           ['no_trigger', 'stop_before_target', 'target_before_stop', 'eod', 'ambiguous_same_bar'][1 + CAST((k * 7 + n) % 5 AS INTEGER)] AS outcome,
           (k * 7 + n) % 5 <> 0 AS entry_triggered, (k * 7 + n) % 5 = 2 AS target_before_stop,
           CASE WHEN (k * 7 + n) % 5 IN (1, 2, 3) THEN ((k * 13 + n * 29) % 200 - 90) / 1000.0::DOUBLE END AS shadow_return,
           CASE WHEN (k * 7 + n) % 5 IN (1, 2, 3) THEN ((k * 13 + n * 29) % 200 - 92) / 1000.0::DOUBLE END AS net_return,
           (k % 50) / 1000.0::DOUBLE AS mfe_pct, (k % 40) / 1000.0::DOUBLE AS mae_pct
    FROM decisions WHERE k % 13 <> 0
    """,
    "decisions",
)
RETURN_SQL = """CASE WHEN status = 'complete' AND fidelity IN ('BAR_ONLY', 'QUOTE_AWARE', 'CONTEXT_AWARE', 'FORWARD_LIVE')
    AND outcome <> 'ambiguous_same_bar' THEN
      CASE WHEN NOT entry_triggered AND outcome = 'no_trigger' THEN 0.0
           WHEN entry_triggered AND outcome IN ('target_before_stop', 'stop_before_target', 'eod') THEN shadow_return END END"""


def decisions(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("k")
    n = F.col("n")
    base = table(spark, folder, "part").select(
        F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 30).alias("n")
    )
    day = F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))

    def part(value, divisor: float):
        return value / F.lit(divisor)

    return base.select(
        F.concat(F.lit("P"), k.cast("string")).alias("symbol"),
        F.concat(F.lit("R"), n.cast("string")).alias("snapshot_id"),
        F.date_format(day, "yyyy-MM-dd").alias("session"),
        F.date_format(day, "yyyy-MM").alias("month"),
        "k",
        "n",
        ((k + n) % 3 != 0).alias("eligible"),
        (k % 7 != 0).alias("has_plan"),
        part((k * 31 + n * 17) % 101, 100.0).alias("technical_score"),
        part((k * 7 + n) % 21, 20.0).alias("market_score"),
        F.when(k % 3 != 1, part(k % 13, 12.0)).alias("news_score"),
        F.when(k % 4 != 1, part(k % 17, 16.0)).alias("social_score"),
        F.when(k % 5 != 1, part(k % 19, 18.0)).alias("fundamental_score"),
        part((k * 11 + n) % 41, 40.0).alias("volatility_score"),
        part((k * 5 + n) % 81 - 40, 1000.0).alias("gap_pct"),
        part(k % 30, 10.0).alias("rvol"),
        F.when(k % 29 != 0, part(k % 25, 2000.0)).alias("spread_pct"),
        part((k * 3 + n) % 31, 30.0).alias("momentum_score"),
        part((k * 13) % 37, 36.0).alias("sector_score"),
        (k % 23 == 0).cast("int").alias("earnings_count"),
        (k % 4).alias("filing_count"),
        (k % 3).alias("news_count"),
        (k % 2).alias("macro_count"),
        (k % 6 != 0).alias("has_premarket"),
        (k % 8 != 0).alias("has_postmarket"),
        (k % 30 == 4 + n % 3).alias("primary"),
        (k % 30 == 4 + n % 2).alias("regular_only_primary"),
    )


def results(spark: SparkSession, folder: str) -> DataFrame:
    k, n = F.col("k"), F.col("n")
    kind = (k * 7 + n) % 5
    names = ("no_trigger", "stop_before_target", "target_before_stop", "eod", "ambiguous_same_bar")
    moved = kind.isin(1, 2, 3)
    base = (k * 13 + n * 29) % 200
    return decisions(spark, folder).filter(k % 13 != 0).select(
        "symbol",
        "snapshot_id",
        "session",
        "month",
        F.when(k % 17 == 0, "unavailable").otherwise("complete").alias("status"),
        F.when(k % 19 == 0, "UNSPECIFIED").otherwise("BAR_ONLY").alias("fidelity"),
        F.get(F.array(*[F.lit(name) for name in names]), kind.cast("int")).alias("outcome"),
        (kind != 0).alias("entry_triggered"),
        (kind == 2).alias("target_before_stop"),
        F.when(moved, (base - 90) / F.lit(1000.0)).alias("shadow_return"),
        F.when(moved, (base - 92) / F.lit(1000.0)).alias("net_return"),
        ((k % 50) / F.lit(1000.0)).alias("mfe_pct"),
        ((k % 40) / F.lit(1000.0)).alias("mae_pct"),
    )


@query(
    "outcome_return",
    f"SELECT snapshot_id, symbol, {RETURN_SQL} AS realized FROM results",
    "results",
)
def outcome_returns(spark: SparkSession, folder: str) -> DataFrame:
    return results(spark, folder).select(
        "snapshot_id", "symbol", outcome_return().alias("realized")
    )


DRAWDOWN_SQL = """
eq AS (SELECT {g}, ret, sum(ln(1 + ret)) OVER (PARTITION BY {g} ORDER BY {o} ROWS UNBOUNDED PRECEDING) AS e, {o} FROM {src} WHERE ret IS NOT NULL),
pk AS (SELECT *, greatest(0, max(e) OVER (PARTITION BY {g} ORDER BY {o} ROWS UNBOUNDED PRECEDING)) AS p FROM eq),
dd AS (SELECT {g}, max(1 - exp(e - p)) AS max_drawdown FROM pk GROUP BY {g})
"""


@query(
    "max_drawdown",
    f"WITH r AS (SELECT month, session, symbol, {RETURN_SQL} AS ret FROM results),"
    + DRAWDOWN_SQL.format(g="month", o="session, symbol", src="r")
    + "SELECT month, round(max_drawdown, 8) AS max_drawdown FROM dd",
    "results",
)
def max_drawdown(spark: SparkSession, folder: str) -> DataFrame:
    rows = settle(results(spark, folder).withColumn("ret", outcome_return()), "ret")
    return research.max_drawdown(rows, ["month"], "ret", "session", ["symbol"]).select(
        "month", F.round("max_drawdown", 8).alias("max_drawdown")
    )


METRICS_SQL = """
SELECT {g}, CAST(count(ret) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS selected, CAST(count_if(coalesce(entry_triggered, FALSE)) AS BIGINT) AS triggered,
  CAST(count_if(coalesce(entry_triggered, FALSE) AND ret IS NOT NULL) AS BIGINT) AS known_triggered, CAST(count_if(ret IS NULL) AS BIGINT) AS unknown,
  round(avg((ret IS NULL)::INT), 8) AS unknown_rate, round(coalesce(avg(ret), 0), 8) AS expectancy, round(coalesce(median(ret), 0), 8) AS median_return,
  round(coalesce(avg(coalesce(target_before_stop, FALSE)::INT) FILTER (coalesce(entry_triggered, FALSE) AND ret IS NOT NULL), 0), 8) AS hit_rate,
  round(coalesce(avg(mfe_pct), 0), 8) AS mean_mfe_pct, round(coalesce(avg(mae_pct), 0), 8) AS mean_mae_pct
FROM {src} GROUP BY {g}
"""
METRICS = [
    "unknown_rate", "expectancy", "median_return", "hit_rate", "mean_mfe_pct", "mean_mae_pct",
]
METRIC_COUNTS = ["count", "selected", "triggered", "known_triggered", "unknown"]


def _metric_columns() -> list:
    return [*METRIC_COUNTS, *[F.round(c, 8).alias(c) for c in (*METRICS, "max_drawdown")]]


@query(
    "outcome_metrics",
    f"WITH r AS (SELECT *, {RETURN_SQL} AS ret FROM results),"
    + DRAWDOWN_SQL.format(g="month", o="session, symbol", src="r")
    + f", m AS ({METRICS_SQL.format(g='month', src='r')}) SELECT m.*, round(coalesce(max_drawdown, 0), 8) AS max_drawdown FROM m LEFT JOIN dd USING (month)",
    "results",
)
def outcome_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return research.outcome_metrics(results(spark, folder), ["month"], "session").select(
        "month", *_metric_columns()
    )


@query(
    "shadow_metrics",
    f"WITH r AS (SELECT sym AS symbol, plan_session AS session, {RETURN_SQL} AS ret FROM (SELECT *, trg IS NOT NULL AS entry_triggered, 'BAR_ONLY' AS fidelity FROM shadow))"
    + """SELECT symbol, CAST(count(ret) AS BIGINT) AS count, CAST(count_if(ret IS NULL) AS BIGINT) AS unknown,
             round(coalesce(avg(ret), 0), 8) AS expectancy, round(coalesce(avg((ret > 0)::INT), 0), 8) AS positive_rate FROM r GROUP BY symbol""",
    "shadow",
)
def shadow_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of the labelled shadow outcomes per symbol."""
    rows = shadow_rows(spark, folder)
    positive = settle(rows.withColumn("ret", outcome_return()), "ret").groupBy("symbol").agg(
        research.hit_rate(F.col("ret")).alias("positive_rate")
    )
    return (
        research.outcome_metrics(rows, ["symbol"], "session_date", ["snapshot_id"])
        .join(positive, "symbol")
        .select(
            "symbol", "count", "unknown", F.round("expectancy", 8).alias("expectancy"),
            F.round("positive_rate", 8).alias("positive_rate"),
        )
    )


@query(
    "evidence_report",
    f"""
WITH r AS (SELECT *, {RETURN_SQL} AS ret FROM results),
s AS (SELECT session, count(*) AS c, count_if(entry_triggered) AS t, count_if(target_before_stop) AS p, sum(ret) AS rs, count(ret) AS rn,
             any_value(n) % 5 <> 0 AS complete FROM r GROUP BY session)
SELECT CAST(sum(c) AS BIGINT) AS candidate_rows, CAST(count(DISTINCT session) AS BIGINT) AS complete_sessions, CAST(sum(t) AS BIGINT) AS triggered_setups,
       CAST(sum(p) AS BIGINT) AS paper_trades, round(sum(rs) / sum(rn), 8) AS expectancy, count(DISTINCT session) >= 15 AS eligible_for_review
FROM s WHERE complete
""",
    "results",
)
def evidence_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = settle(results(spark, folder).withColumn("ret", outcome_return()), "ret")
    per_session = rows.groupBy("session").agg(
        F.count("*").alias("candidate_rows"),
        F.count_if("entry_triggered").alias("triggered_setups"),
        F.count_if("target_before_stop").alias("paper_trades"),
        F.sum("ret").alias("return_sum"),
        F.count("ret").alias("return_count"),
        (F.max(F.substring("snapshot_id", 2, 20).cast("long")) % 5 != 0).alias("complete"),
    )
    return research.evidence_report(per_session).withColumn(
        "expectancy", F.round("expectancy", 8)
    )


sql_view(
    "labelled",
    """
    SELECT *, CASE WHEN volatility_score >= 0.75 THEN 'HIGH_VOLATILITY' WHEN volatility_score <= 0.25 THEN 'LOW_VOLATILITY'
        WHEN market_score >= 0.62::DOUBLE THEN 'BULLISH_TREND' WHEN market_score <= 0.38::DOUBLE THEN 'BEARISH_TREND' ELSE 'RANGE' END AS market,
      CASE WHEN gap_pct >= 0.02::DOUBLE THEN 'GAP_UP' WHEN gap_pct <= -0.02::DOUBLE THEN 'GAP_DOWN'
        WHEN coalesce(nullif(rvol, 0), 1) >= 2 THEN 'HIGH_RVOL' WHEN momentum_score >= 0.65::DOUBLE THEN 'MOMENTUM'
        WHEN momentum_score <= 0.35::DOUBLE THEN 'MEAN_REVERTING' WHEN sector_score >= 0.62::DOUBLE THEN 'SECTOR_LEADERSHIP'
        WHEN sector_score <= 0.38::DOUBLE THEN 'SECTOR_LAGGING' ELSE 'NEUTRAL' END AS stock,
      CASE WHEN earnings_count <> 0 THEN 'EARNINGS' WHEN filing_count <> 0 THEN 'FILING' WHEN news_count <> 0 THEN 'COMPANY_NEWS'
        WHEN macro_count <> 0 THEN 'MACRO_HEAVY' ELSE 'NO_MATERIAL_CATALYST' END AS catalyst,
      CASE WHEN NOT eligible THEN 'HARD_GATE_REJECTED' WHEN coalesce(spread_pct, 0) >= 0.01::DOUBLE THEN 'WIDE_SPREAD'
        WHEN news_score IS NULL OR social_score IS NULL OR fundamental_score IS NULL THEN 'MISSING_CONTEXT'
        ELSE 'COMPLETE_TIGHT_SPREAD' END AS execution_data
    FROM decisions
    """,
    "decisions",
)


@query(
    "regimes",
    "SELECT snapshot_id, symbol, market, stock, catalyst, execution_data FROM labelled",
    "labelled",
)
def regimes(spark: SparkSession, folder: str) -> DataFrame:
    labels = research.regimes()
    return decisions(spark, folder).select(
        "snapshot_id", "symbol", *[expr.alias(name) for name, expr in labels.items()]
    )


@query(
    "regime_breakdown",
    """
WITH u AS (UNPIVOT (SELECT symbol, CASE WHEN r.symbol IS NULL THEN 'UNKNOWN' ELSE market END AS market,
    CASE WHEN r.symbol IS NULL THEN 'UNKNOWN' ELSE stock END AS stock, CASE WHEN r.symbol IS NULL THEN 'UNKNOWN' ELSE catalyst END AS catalyst,
    CASE WHEN r.symbol IS NULL THEN 'UNKNOWN' ELSE execution_data END AS execution_data
  FROM labelled l LEFT JOIN (SELECT snapshot_id, symbol FROM results) r USING (snapshot_id, symbol))
  ON market, stock, catalyst, execution_data INTO NAME family VALUE label)
SELECT family, label, CAST(count(*) AS BIGINT) AS rows FROM u GROUP BY ALL
""".replace("SELECT symbol, CASE", "SELECT l.symbol, CASE"),
    "labelled",
    "results",
)
def regime_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of rows with an outcome; the others count as UNKNOWN."""
    labels = research.regimes()
    df = decisions(spark, folder)
    known = results(spark, folder).select("snapshot_id", "symbol", F.lit(True).alias("known"))
    labelled = df.join(known, ["snapshot_id", "symbol"], "left").select(
        *[F.when(F.col("known"), expr).alias(name) for name, expr in labels.items()]
    )
    return research.regime_breakdown(labelled)


def _w(*names: str) -> str:
    weights = {"technical": 0.5, "market": 0.2, "news": 0.2, "social": 0.05, "fundamentals": 0.05}
    total = sum(weights[name] for name in names)
    column = {"news": "news_score", "social": "social_score", "fundamentals": "fundamental_score"}
    scale = {name: weights[name] / total for name in names}
    tech = f"{scale['technical']!r}::DOUBLE" + "".join(
        f" + CASE WHEN {column[x]} IS NULL THEN {scale[x]!r}::DOUBLE ELSE 0 END" for x in names if x in column
    )
    text = f"technical_score * ({tech})"
    if "market" in names:
        text += f" + market_score * {scale['market']!r}::DOUBLE"
    for x in names:
        if x in column:
            text += f" + coalesce({column[x]}, 0) * {scale[x]!r}::DOUBLE"
    return text


sql_view(
    "variants",
    " UNION ALL ".join(
        f"SELECT '{name}' AS variant, snapshot_id, symbol, session, {_w(*names)} AS score FROM decisions WHERE eligible AND has_plan"
        for name, names in research.VARIANTS.items()
    ),
    "decisions",
)
sql_view(
    "variant_ranked",
    f"""
    SELECT v.*, coalesce(r.status, 'unavailable') AS status, r.entry_triggered, r.target_before_stop, r.mfe_pct, r.mae_pct, r.ret,
           row_number() OVER (PARTITION BY variant, v.session ORDER BY score DESC, v.symbol) AS rn
    FROM variants v LEFT JOIN (SELECT *, {RETURN_SQL} AS ret FROM results) r USING (snapshot_id, symbol)
    """,
    "variants",
    "results",
)


@query(
    "ablation_report",
    "WITH r AS (SELECT * FROM variant_ranked WHERE rn = 1),"
    + DRAWDOWN_SQL.format(g="variant", o="session, symbol", src="r")
    + f", m AS ({METRICS_SQL.format(g='variant', src='r')})"
    + """, c AS (SELECT variant, session, count(*) = count(ret) AS known, max(ret) = max(ret) FILTER (rn <= 5) AS hit FROM variant_ranked GROUP BY ALL),
  k AS (SELECT variant, avg(hit::INT) AS rate FROM c WHERE known GROUP BY variant)
SELECT m.*, round(coalesce(max_drawdown, 0), 8) AS max_drawdown, round(coalesce(rate, 0), 8) AS top5_capture_rate
FROM m LEFT JOIN dd USING (variant) LEFT JOIN k USING (variant)""",
    "variant_ranked",
)
def ablation_report(spark: SparkSession, folder: str) -> DataFrame:
    return research.ablation_report(decisions(spark, folder), results(spark, folder)).select(
        "variant", *_metric_columns(), F.round("top5_capture_rate", 8).alias("top5_capture_rate")
    )


@query(
    "activation_report",
    """
WITH s AS (SELECT session, count(*) AS n, count_if(has_premarket) AS pre, count_if(has_postmarket) AS post,
                  min(symbol) FILTER (primary) AS a, min(symbol) FILTER (regular_only_primary) AS b FROM decisions GROUP BY session HAVING count(*) = 30)
SELECT CAST(count(*) AS BIGINT) AS complete_sessions, round(sum(pre) / sum(n), 8) AS premarket_coverage_ratio,
       round(sum(post) / sum(n), 8) AS postmarket_coverage_ratio, CAST(count_if(a IS DISTINCT FROM b) AS BIGINT) AS decision_changes FROM s
""".replace("FILTER (primary)", "FILTER (\"primary\")"),
    "decisions",
)
def activation_report(spark: SparkSession, folder: str) -> DataFrame:
    summary, _ = research.activation_report(decisions(spark, folder), results(spark, folder))
    return summary.withColumns(
        {c: F.round(c, 8) for c in ("premarket_coverage_ratio", "postmarket_coverage_ratio")}
    )


@query(
    "activation_metrics",
    f"""
WITH c AS (SELECT session FROM decisions GROUP BY session HAVING count(*) = 30),
p AS (SELECT 'extended_hours' AS selection, snapshot_id, symbol, session FROM decisions WHERE "primary"
      UNION ALL SELECT 'regular_only', snapshot_id, symbol, session FROM decisions WHERE regular_only_primary),
r AS (SELECT selection, p.session, p.symbol, r.* EXCLUDE (snapshot_id, symbol, session) FROM p SEMI JOIN c USING (session)
      LEFT JOIN (SELECT *, {RETURN_SQL} AS ret FROM results) r ON r.snapshot_id = p.snapshot_id AND r.symbol = p.symbol),"""
    + DRAWDOWN_SQL.format(g="selection", o="session, symbol", src="r")
    + f", m AS ({METRICS_SQL.format(g='selection', src='r')}) SELECT m.*, round(coalesce(max_drawdown, 0), 8) AS max_drawdown FROM m LEFT JOIN dd USING (selection)",
    "decisions",
    "results",
)
def activation_metrics(spark: SparkSession, folder: str) -> DataFrame:
    _, metrics = research.activation_report(decisions(spark, folder), results(spark, folder))
    return metrics.select("selection", *_metric_columns())


@query(
    "monthly_quality",
    f"""
WITH r AS (SELECT *, {RETURN_SQL} AS ret FROM results),
j AS (SELECT d.month, d.session, r.ret FROM decisions d LEFT JOIN r USING (snapshot_id, symbol)),
s AS (SELECT month, session, count(*) AS n, count_if(ret IS NULL) AS u FROM j GROUP BY ALL),
a AS (SELECT month, count(*) AS sessions, sum(n) AS candidate_rows, count_if(n = 30) AS complete_sessions, sum(u) AS unknown_outcomes FROM s GROUP BY month),
b AS (SELECT month, count(*) AS outcome_rows, count_if(status = 'complete') AS shadow_rows, avg(shadow_return) AS raw, avg(net_return) AS net FROM results GROUP BY month)
SELECT a.month, CAST(sessions AS BIGINT) AS sessions, CAST(candidate_rows AS BIGINT) AS candidate_rows, CAST(complete_sessions AS BIGINT) AS complete_sessions,
       CAST(unknown_outcomes AS BIGINT) AS unknown_outcomes, CAST(outcome_rows AS BIGINT) AS outcome_rows, CAST(shadow_rows AS BIGINT) AS shadow_rows,
       round(coalesce(raw, 0), 8) AS raw_expectancy, round(coalesce(net, 0), 8) AS net_expectancy
FROM a LEFT JOIN b USING (month)
""",
    "decisions",
    "results",
)
def monthly_quality(spark: SparkSession, folder: str) -> DataFrame:
    return research.monthly_quality(decisions(spark, folder), results(spark, folder)).withColumns(
        {c: F.round(c, 8) for c in ("raw_expectancy", "net_expectancy")}
    )


# ---- model evidence -----------------------------------------------------------------

WINDOWS = ModelWindows()
sql_view(
    "usable",
    """
    SELECT d.session, d.snapshot_id, d.symbol, CAST(r.net_return > 0 AS INTEGER) AS label,
           CASE WHEN NOT eligible THEN 'ineligible' WHEN spread_pct IS NULL THEN 'missing_features' WHEN r.net_return IS NULL THEN 'unknown_outcome' END AS excluded,
           market_score
    FROM decisions d LEFT JOIN results r USING (snapshot_id, symbol)
    """,
    "decisions",
    "results",
)


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return model.model_rows(decisions(spark, folder), results(spark, folder))


@query(
    "model_exclusions",
    """SELECT CAST(count(*) AS BIGINT) AS rows_considered, CAST(count_if(excluded IS NULL) AS BIGINT) AS rows_used,
         CAST(count_if(excluded = 'ineligible') AS BIGINT) AS ineligible, CAST(count_if(excluded = 'missing_features') AS BIGINT) AS missing_features,
         CAST(count_if(excluded = 'unknown_outcome') AS BIGINT) AS unknown_outcome,
         CASE WHEN count_if(excluded IS NULL) >= 50 THEN 'READY' ELSE 'INSUFFICIENT_DATA' END AS status FROM usable""",
    "usable",
)
def model_exclusions(spark: SparkSession, folder: str) -> DataFrame:
    return model.exclusion_counts(_rows(spark, folder), WINDOWS)


def _folds(spark: SparkSession, folder: str) -> DataFrame:
    usable = _rows(spark, folder).filter("excluded IS NULL").drop("excluded")
    return model.walk_forward(usable, WINDOWS)


@query(
    "walk_forward_folds",
    """
WITH o AS (SELECT *, row_number() OVER (ORDER BY session, snapshot_id, symbol) - 1 AS i, count(*) OVER () AS n FROM usable WHERE excluded IS NULL),
f AS (SELECT unnest(range(0, CAST((SELECT (max(n) - 50) // 10 + 1 FROM o) AS BIGINT))) AS fold)
SELECT CAST(fold AS BIGINT) AS fold, CAST(i AS BIGINT) AS row, symbol, CASE WHEN i - fold * 10 < 30 THEN 'train' WHEN i - fold * 10 < 40 THEN 'validation' ELSE 'holdout' END AS part
FROM o JOIN f ON i >= fold * 10 AND i < fold * 10 + 50
""",
    "usable",
)
def walk_forward_folds(spark: SparkSession, folder: str) -> DataFrame:
    return _folds(spark, folder).select(
        F.col("fold").cast("long").alias("fold"), F.col("row").cast("long").alias("row"),
        "symbol", "part",
    )


@query(
    "binary_metrics",
    """
WITH p AS (SELECT substr(session, 1, 7) AS month, market_score AS p, label AS y, least(greatest(market_score, 1e-12), 1 - 1e-12) AS s FROM usable WHERE excluded IS NULL)
SELECT month, CAST(count(*) AS BIGINT) AS rows, round(-avg(y * ln(s) + (1 - y) * ln(1 - s)), 6) AS log_loss,
       round(avg((p - y) * (p - y)), 8) AS brier, round(avg(((p >= 0.5) = (y = 1))::INT), 8) AS accuracy FROM p GROUP BY month
""",
    "usable",
)
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder).filter("excluded IS NULL").select(
        F.substring("session", 1, 7).alias("month"), F.col("market_score").alias("probability"), "label"
    )
    return model.binary_metrics(rows, ["month"]).select(
        "month", "rows", F.round("log_loss", 6).alias("log_loss"),
        F.round("brier", 8).alias("brier"), F.round("accuracy", 8).alias("accuracy"),
    )


@query("walk_forward_model")
def walk_forward_model(spark: SparkSession, folder: str) -> DataFrame:
    """Validation and holdout metrics of the logistic baseline per fold."""
    scored = model.walk_forward_predictions(_folds(spark, folder), WINDOWS)
    return model.binary_metrics(scored, ["fold", "part"])


# ---- lineage ------------------------------------------------------------------------

sql_view(
    "experiments",
    """
    SELECT o_orderkey AS experiment_id, strftime(o_orderdate, '%Y-%m') AS cycle_id, o_orderpriority AS dataset_version,
           CAST(epoch_us(o_orderdate) + o_orderkey * 1000000 AS BIGINT) AS decided_us,
           CASE WHEN o_orderkey % 20 >= 15 AND o_orderkey % 3 > 0 AND o_orderkey % 7 >= 3 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0
                THEN 'PROMOTED' ELSE 'NO CHANGE' END AS result
    FROM orders
    """,
)


def experiments(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    key = F.col("o_orderkey")
    base = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    gates = orders.select(
        key.alias("experiment_id"),
        F.date_format("o_orderdate", "yyyy-MM").alias("cycle_id"),
        F.col("o_orderpriority").alias("dataset_version"),
        F.timestamp_micros(base + key * 1_000_000).alias("decided_at"),
        F.concat(F.lit("c"), key.cast("string")).alias("challenger_id"),
        F.lit("champion").alias("champion_id"),
        (key % 20).alias("complete_sessions"),
        (key % 3).alias("triggered_setups"),
        (key % 7).alias("expectancy"),
        F.lit(3).alias("champion_expectancy"),
        F.lit(0.1).alias("max_drawdown"),
        F.lit(0.1).alias("champion_drawdown"),
        (key % 11 != 0).alias("reproducible"),
        F.lit(True).alias("forward_confirmed"),
        (key % 13 == 0).alias("hard_risk_regression"),
        F.lit(False).alias("dominated"),
        F.lit(False).alias("fragile"),
    )
    return gates.withColumn("result", research.promotion_result())


@query(
    "champion_cycles",
    """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY cycle_id, result ORDER BY decided_us, experiment_id) AS fst,
                  row_number() OVER (PARTITION BY cycle_id, result ORDER BY decided_us DESC, experiment_id DESC) AS lst FROM experiments),
p AS (SELECT * FROM r WHERE result = 'PROMOTED' AND fst = 1), o AS (SELECT * FROM r WHERE result <> 'PROMOTED' AND lst = 1),
c AS (SELECT DISTINCT cycle_id FROM experiments)
SELECT c.cycle_id, CASE WHEN p.cycle_id IS NOT NULL THEN 'c' || p.experiment_id ELSE 'champion' END AS champion_id,
       CASE WHEN p.cycle_id IS NOT NULL THEN 'PROMOTED' ELSE 'NO CHANGE' END AS result, coalesce(p.decided_us, o.decided_us) AS decided_us
FROM c LEFT JOIN p USING (cycle_id) LEFT JOIN o USING (cycle_id)
""",
    "experiments",
)
def champion_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return research.champion_cycles(experiments(spark, folder)).select(
        "cycle_id", "champion_id", "result", us("decided_at").alias("decided_us")
    )


@query(
    "holdout_first_use",
    """SELECT cycle_id AS period, dataset_version, arg_min(experiment_id, (decided_us, experiment_id)) AS experiment_id,
              CAST(count(*) - 1 AS BIGINT) AS refused FROM experiments GROUP BY ALL""",
    "experiments",
)
def holdout_first_use(spark: SparkSession, folder: str) -> DataFrame:
    uses = experiments(spark, folder).select(
        F.col("cycle_id").alias("period"), "dataset_version", "experiment_id",
        F.col("decided_at").alias("used_at"),
    )
    return research.holdout_reuse(uses).select(
        "period", "dataset_version", "experiment_id", "refused"
    )


@query(
    "dataset_first_wins",
    """SELECT dataset_version, cycle_id, arg_min(experiment_id, (decided_us, experiment_id)) AS first_experiment,
              arg_max(experiment_id, (decided_us, experiment_id)) AS last_experiment FROM experiments GROUP BY ALL""",
    "experiments",
)
def dataset_first_wins(spark: SparkSession, folder: str) -> DataFrame:
    events = experiments(spark, folder).select(
        "dataset_version", "cycle_id", "experiment_id", "decided_at"
    )
    key, at = ["dataset_version", "cycle_id"], ["decided_at", "experiment_id"]
    first = research.first_wins(events, key, at).withColumnRenamed(
        "experiment_id", "first_experiment"
    )
    last = research.last_wins(events, key, at).withColumnRenamed("experiment_id", "last_experiment")
    return first.join(last.drop("decided_at"), key).select(*key, "first_experiment", "last_experiment")


@query(
    "lineage_counts",
    """SELECT 'datasets' AS table_name, CAST(count(DISTINCT (dataset_version, cycle_id)) AS BIGINT) AS rows FROM experiments
       UNION ALL SELECT 'experiments', CAST(count(*) AS BIGINT) FROM experiments
       UNION ALL SELECT 'champion_cycles', CAST(count(DISTINCT cycle_id) AS BIGINT) FROM experiments""",
    "experiments",
)
def lineage_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = experiments(spark, folder)
    return research.table_counts(
        datasets=events.select("dataset_version", "cycle_id").distinct(),
        experiments=events,
        champion_cycles=events.select("cycle_id").distinct(),
    )

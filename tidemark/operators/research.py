"""Evidence aggregation: outcome metrics, regimes, ablations, activation, lineage.

Decision rows carry snapshot_id, symbol, session, eligible, technical_score, market_score,
news_score, social_score, fundamental_score; outcome rows carry snapshot_id, symbol,
status, fidelity, entry_triggered, outcome, target_before_stop, shadow_return, net_return,
mfe_pct, mae_pct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clip, finite
from tidemark.functions.scores import component_score
from tidemark.operators.ordering import group_median
from tidemark.operators.outcomes import outcome_return
from tidemark.operators.scaling import settle
from tidemark.operators.segments import KeyedSeries, Segmentation
from tidemark.policies import RankingWeights

# Fixed values ------------------------------------------------------------------------
VARIANTS = {
    "A_TECHNICAL": ("technical",),
    "B_TECH_MARKET": ("technical", "market"),
    "C_PLUS_NEWS": ("technical", "market", "news"),
    "D_PLUS_REDDIT": ("technical", "market", "news", "social"),
    "E_FULL": ("technical", "market", "news", "social", "fundamentals"),
}
REGIME_VERSION = "regime-v2"
REGIME_FAMILIES = ("market", "stock", "catalyst", "execution_data")
MINIMUM_SESSIONS = 15
COHORT_ROWS = 30
PROMOTED, NO_CHANGE = "PROMOTED", "NO CHANGE"
# -------------------------------------------------------------------------------------

KEY = ["snapshot_id", "symbol"]


def max_drawdown(
    returns: DataFrame,
    group: Sequence[str],
    value: str,
    at: str,
    tie_break: Sequence[str] = (),
    *,
    segmentation: Segmentation | None = None,
) -> DataFrame:
    """Largest fall of compounded equity from its running peak (peak starts at 1).

    Equity is carried as a running sum of logarithms, so a long series is cut into segments
    and carried across them. A return of -1 loses everything; below -1 there is no result.
    """
    frame = returns.filter(F.col(value).isNotNull()).withColumns(
        {
            "__us": F.unix_micros(F.col(at).cast("timestamp")),
            "__log": F.when(F.col(value) > -1, F.log1p(value)).otherwise(F.lit(0.0)),
        }
    )
    segmentation = segmentation or Segmentation.for_input(frame, group, F.col("__us"))
    order = ["__us", *tie_break]
    series = KeyedSeries(frame, group, order, segmentation)
    series.accumulate(sums={"__equity": F.col("__log")})
    series.accumulate(maxima={"__peak": F.col("__equity")})
    fall = 1 - F.exp(F.col("__equity") - F.greatest(F.lit(0.0), F.col("__peak")))
    return (
        series.finish()
        .groupBy(*group)
        .agg(
            F.when(F.min(value) < -1, F.lit(None).cast("double"))
            .when(F.min(value) == -1, F.lit(1.0))
            .otherwise(F.max(fall))
            .alias("max_drawdown")
        )
    )


def hit_rate(value: Column) -> Column:
    """Aggregate: share of positive values, 0 when there are none."""
    return F.coalesce(F.avg(F.when(value.isNotNull(), (value > 0).cast("double"))), F.lit(0.0))


def outcome_metrics(
    rows: DataFrame, group: Sequence[str], at: str, tie_break: Sequence[str] = ("symbol",)
) -> DataFrame:
    """Counts, expectancy, median, hit rate, drawdown and mean excursions per group."""
    valued = settle(rows.withColumn("__ret", outcome_return()), "__ret")
    ret = F.col("__ret")
    triggered = F.coalesce(F.col("entry_triggered"), F.lit(False))
    known = triggered & ret.isNotNull()
    hit = F.coalesce(F.col("target_before_stop"), F.lit(False))
    zero = F.lit(0.0)
    sums = valued.groupBy(*group).agg(
        F.count("__ret").alias("count"),
        F.count("*").alias("selected"),
        F.count_if(triggered).alias("triggered"),
        F.count_if(known).alias("known_triggered"),
        F.count_if(ret.isNull()).alias("unknown"),
        F.avg(ret.isNull().cast("double")).alias("unknown_rate"),
        F.coalesce(F.avg("__ret"), zero).alias("expectancy"),
        F.coalesce(F.avg(F.when(known, hit.cast("double"))), zero).alias("hit_rate"),
        F.coalesce(F.avg(finite(F.col("mfe_pct"))), zero).alias("mean_mfe_pct"),
        F.coalesce(F.avg(finite(F.col("mae_pct"))), zero).alias("mean_mae_pct"),
    )
    medians = group_median(valued, group, ret, name="median_return")
    falls = max_drawdown(valued, group, "__ret", at, tie_break)
    return (
        sums.join(medians, list(group), "left")
        .join(falls, list(group), "left")
        .withColumns(
            {
                "median_return": F.coalesce("median_return", zero),
                "max_drawdown": F.coalesce("max_drawdown", zero),
            }
        )
    )


def evidence_report(sessions: DataFrame, minimum_sessions: int = MINIMUM_SESSIONS) -> DataFrame:
    """Totals over complete sessions and whether there are enough of them.

    `sessions`: session, candidate_rows, triggered_setups, paper_trades, return_sum,
    return_count, complete.
    """
    complete = sessions.filter("complete")
    total = F.sum("return_count")
    return complete.agg(
        F.coalesce(F.sum("candidate_rows"), F.lit(0)).alias("candidate_rows"),
        F.count_distinct("session").alias("complete_sessions"),
        F.coalesce(F.sum("triggered_setups"), F.lit(0)).alias("triggered_setups"),
        F.coalesce(F.sum("paper_trades"), F.lit(0)).alias("paper_trades"),
        F.coalesce(F.sum("return_sum") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("expectancy"),
        (F.count_distinct("session") >= minimum_sessions).alias("eligible_for_review"),
    )


def regimes() -> dict[str, Column]:
    """Decision-time labels; unreadable scores count as neutral."""

    def score(*names: str) -> Column:
        return F.coalesce(clip(F.coalesce(*[F.col(name) for name in names])), F.lit(0.5))

    def number(name: str, default: float) -> Column:
        value = F.col(name)
        return F.when(value.isNull() | (value == 0), F.lit(default)).otherwise(value)

    market, volatility = score("market_score"), score("volatility_score")
    gap, rvol = number("gap_pct", 0.0), number("rvol", 1.0)
    momentum, sector = score("momentum_score"), score("sector_score")

    def any_of(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) != 0

    missing = (
        F.col("news_score").isNull()
        | F.col("social_score").isNull()
        | F.col("fundamental_score").isNull()
    )
    return {
        "market": F.when(volatility >= 0.75, "HIGH_VOLATILITY")
        .when(volatility <= 0.25, "LOW_VOLATILITY")
        .when(market >= 0.62, "BULLISH_TREND")
        .when(market <= 0.38, "BEARISH_TREND")
        .otherwise("RANGE"),
        "stock": F.when(gap >= 0.02, "GAP_UP")
        .when(gap <= -0.02, "GAP_DOWN")
        .when(rvol >= 2.0, "HIGH_RVOL")
        .when(momentum >= 0.65, "MOMENTUM")
        .when(momentum <= 0.35, "MEAN_REVERTING")
        .when(sector >= 0.62, "SECTOR_LEADERSHIP")
        .when(sector <= 0.38, "SECTOR_LAGGING")
        .otherwise("NEUTRAL"),
        "catalyst": F.when(any_of("earnings_count"), "EARNINGS")
        .when(any_of("filing_count"), "FILING")
        .when(any_of("news_count"), "COMPANY_NEWS")
        .when(any_of("macro_count"), "MACRO_HEAVY")
        .otherwise("NO_MATERIAL_CATALYST"),
        "execution_data": F.when(~F.coalesce(F.col("eligible"), F.lit(False)), "HARD_GATE_REJECTED")
        .when(number("spread_pct", 0.0) >= 0.01, "WIDE_SPREAD")
        .when(missing, "MISSING_CONTEXT")
        .otherwise("COMPLETE_TIGHT_SPREAD"),
    }


def regime_breakdown(rows: DataFrame, families: Sequence[str] = REGIME_FAMILIES) -> DataFrame:
    """Row counts per family and label; absent labels count as UNKNOWN."""
    cells = F.array(
        *[
            F.struct(
                F.lit(name).alias("family"),
                F.coalesce(F.col(name), F.lit("UNKNOWN")).alias("label"),
            )
            for name in families
        ]
    )
    return rows.select(F.inline(cells)).groupBy("family", "label").agg(F.count("*").alias("rows"))


def variant_scores(decisions: DataFrame, weights: RankingWeights | None = None) -> DataFrame:
    """Rank score of every eligible planned row under each component subset."""
    weights = weights or RankingWeights()
    raw = {
        "technical": clip(F.col("technical_score")),
        "market": F.col("market_score"),
        "news": F.col("news_score"),
        "social": F.col("social_score"),
        "fundamentals": F.col("fundamental_score"),
    }

    def score(names: tuple[str, ...]) -> Column:
        absent = F.lit(None).cast("double")
        parts = {name: (raw[name] if name in names else absent) for name in raw}
        parts["technical"] = raw["technical"]
        if "market" not in names:
            parts["market"] = F.lit(0.0)
        return component_score(weights.only(names), parts)

    cells = F.array(
        *[
            F.struct(F.lit(name).alias("variant"), score(names).alias("variant_score"))
            for name, names in VARIANTS.items()
        ]
    )
    return decisions.filter(F.col("eligible") & F.col("has_plan")).select(
        *KEY, "session", F.inline(cells)
    )


def with_outcomes(rows: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Left join; a row without an outcome becomes an explicit `unavailable` one."""
    columns = [name for name in outcomes.columns if name not in (*rows.columns, "session")]
    return rows.join(outcomes.select(*KEY, *columns), KEY, "left").withColumn(
        "status", F.coalesce("status", F.lit("unavailable"))
    )


def ablation_report(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Metrics of each variant's top pick per session, and how often its top five held the
    best realized return (over sessions in which every outcome is known)."""
    scored = with_outcomes(variant_scores(decisions), outcomes).withColumn(
        "__ret", outcome_return()
    )
    scored = settle(scored, "__ret")
    order = F.struct(-F.col("variant_score"), F.col("symbol"))
    body = F.struct(*[c for c in scored.columns if c not in ("variant", "session")])
    chosen = (
        scored.groupBy("variant", "session")
        .agg(F.min_by(body, order).alias("__r"))
        .select("variant", "session", "__r.*")
    )
    metrics = outcome_metrics(chosen, ["variant"], "session", ["symbol"])
    group = ["variant", "session"]
    best = scored.groupBy(*group).agg(
        F.bool_and(F.col("__ret").isNotNull()).alias("__known"), F.max("__ret").alias("__best")
    )
    ranked = Window.partitionBy(*group).orderBy(F.col("variant_score").desc(), "symbol")
    top = (
        scored.select(*group, "symbol", "variant_score", "__ret")
        .withColumn("__rn", F.row_number().over(ranked))
        .filter(F.col("__rn") <= 5)
        .groupBy(*group)
        .agg(F.max("__ret").alias("__top"))
    )
    captures = (
        best.filter("__known")
        .join(top, group)
        .groupBy("variant")
        .agg(F.avg((F.col("__top") == F.col("__best")).cast("double")).alias("top5_capture_rate"))
    )
    return metrics.join(captures, "variant", "left").withColumn(
        "top5_capture_rate", F.coalesce("top5_capture_rate", F.lit(0.0))
    )


def complete_sessions(decisions: DataFrame, rows: int = COHORT_ROWS) -> DataFrame:
    return decisions.groupBy("session").agg(F.count("*").alias("n")).filter(F.col("n") == rows)


def activation_report(
    decisions: DataFrame, outcomes: DataFrame, rows: int = COHORT_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Regular-only against extended selections over complete sessions.

    First frame: one row of coverage ratios and decision changes. Second: outcome metrics of
    the two selections. `decisions` also carries has_premarket, has_postmarket, primary and
    regular_only_primary.
    """
    complete = decisions.join(complete_sessions(decisions, rows).select("session"), "session")
    per_session = complete.groupBy("session").agg(
        F.count("*").alias("n"),
        F.count_if("has_premarket").alias("pre"),
        F.count_if("has_postmarket").alias("post"),
        F.min(F.when(F.col("primary"), F.col("symbol"))).alias("a"),
        F.min(F.when(F.col("regular_only_primary"), F.col("symbol"))).alias("b"),
    )
    total = F.nullif(F.sum("n"), F.lit(0))
    summary = per_session.agg(
        F.count("*").alias("complete_sessions"),
        F.coalesce(F.sum("pre") / total, F.lit(0.0)).alias("premarket_coverage_ratio"),
        F.coalesce(F.sum("post") / total, F.lit(0.0)).alias("postmarket_coverage_ratio"),
        F.count_if(~F.equal_null("a", "b")).alias("decision_changes"),
    )
    picks = complete.filter(F.col("primary") | F.col("regular_only_primary")).select(
        *KEY,
        "session",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("regular_only_primary"), "regular_only"),
                    F.when(F.col("primary"), "extended_hours"),
                )
            )
        ).alias("selection"),
    )
    metrics = outcome_metrics(with_outcomes(picks, outcomes), ["selection"], "session")
    return summary, metrics


def monthly_quality(decisions: DataFrame, outcomes: DataFrame, rows: int = COHORT_ROWS) -> DataFrame:
    """Sessions, rows, complete sessions, unknown outcomes and raw against net expectancy."""
    joined = with_outcomes(decisions.select(*KEY, "session", "month"), outcomes)
    per_session = joined.withColumn("__ret", outcome_return()).groupBy("month", "session").agg(
        F.count("*").alias("n"), F.count_if(F.col("__ret").isNull()).alias("unknown")
    )
    by_month = per_session.groupBy("month").agg(
        F.count("*").alias("sessions"),
        F.sum("n").alias("candidate_rows"),
        F.count_if(F.col("n") == rows).alias("complete_sessions"),
        F.sum("unknown").alias("unknown_outcomes"),
    )
    zero = F.lit(0.0)
    labels = outcomes.groupBy("month").agg(
        F.count("*").alias("outcome_rows"),
        F.count_if(F.col("status") == "complete").alias("shadow_rows"),
        F.coalesce(F.avg(finite(F.col("shadow_return"))), zero).alias("raw_expectancy"),
        F.coalesce(F.avg(finite(F.col("net_return"))), zero).alias("net_expectancy"),
    )
    return by_month.join(labels, "month", "left")


# ---- lineage ------------------------------------------------------------------------


def first_wins(events: DataFrame, key: Sequence[str], at: Sequence[str]) -> DataFrame:
    """Keep the first event per key (datasets, algorithms, holdouts)."""
    rest = [name for name in events.columns if name not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*at)).alias("__r")).select(
        *key, "__r.*"
    )


def last_wins(events: DataFrame, key: Sequence[str], at: Sequence[str]) -> DataFrame:
    """Keep the last event per key (experiments and their results)."""
    rest = [name for name in events.columns if name not in key]
    return events.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*at)).alias("__r")).select(
        *key, "__r.*"
    )


def experiment_status(experiments: DataFrame, results: DataFrame) -> DataFrame:
    """Current experiments; a recorded result replaces the proposed status."""
    latest = last_wins(results, ["experiment_id"], ["recorded_at"]).select(
        "experiment_id", F.col("result").alias("__result")
    )
    return (
        last_wins(experiments, ["experiment_id"], ["recorded_at"])
        .join(latest, "experiment_id", "left")
        .withColumn("status", F.coalesce("__result", "status"))
        .drop("__result")
    )


def promotion_result(minimum_sessions: int = MINIMUM_SESSIONS) -> Column:
    """All nine gates must hold."""
    gates = (
        F.col("complete_sessions") >= minimum_sessions,
        F.col("triggered_setups") > 0,
        F.col("expectancy") >= F.col("champion_expectancy"),
        F.col("max_drawdown") <= F.col("champion_drawdown"),
        F.col("reproducible"),
        F.col("forward_confirmed"),
        ~F.col("hard_risk_regression"),
        ~F.col("dominated"),
        ~F.col("fragile"),
    )
    passed = F.lit(True)
    for gate in gates:
        passed = passed & F.coalesce(gate, F.lit(False))
    return F.when(passed, PROMOTED).otherwise(NO_CHANGE)


def activation_ready(min_sessions: int = 15, min_coverage: float = 0.90) -> Column:
    flags = (
        "holdout_consumed", "forward_confirmed", "manual_approval", "reproducible",
        "no_hard_risk_regression", "thresholds_frozen",
    )
    ready = (F.col("complete_sessions") >= min_sessions) & (
        F.least("premarket_coverage_ratio", "postmarket_coverage_ratio") >= min_coverage
    )
    for name in flags:
        ready = ready & F.coalesce(F.col(name), F.lit(False))
    return ready


def champion_cycles(evidence: DataFrame) -> DataFrame:
    """Decision per cycle: the first promotion sticks, else the latest NO CHANGE.

    `evidence`: cycle_id, experiment_id, challenger_id, champion_id, decided_at, result.
    """
    when = F.struct("decided_at", "experiment_id")
    row = F.struct("experiment_id", "challenger_id", "champion_id", "decided_at")
    promoted = F.col("result") == PROMOTED
    picked = evidence.groupBy("cycle_id").agg(
        F.min_by(row, F.when(promoted, when)).alias("first_promotion"),
        F.max_by(row, F.when(~promoted, when)).alias("last_other"),
    )
    won = F.col("first_promotion").isNotNull()
    return picked.select(
        "cycle_id",
        F.when(won, F.col("first_promotion.challenger_id"))
        .otherwise(F.col("last_other.champion_id"))
        .alias("champion_id"),
        F.col("first_promotion.experiment_id").alias("promoted_experiment_id"),
        F.when(won, PROMOTED).otherwise(NO_CHANGE).alias("result"),
        F.when(won, F.col("first_promotion.decided_at"))
        .otherwise(F.col("last_other.decided_at"))
        .alias("decided_at"),
    )


def holdout_reuse(uses: DataFrame) -> DataFrame:
    """First use of each holdout and how many later attempts were refused."""
    first = first_wins(uses, ["period", "dataset_version"], ["used_at", "experiment_id"])
    counts = uses.groupBy("period", "dataset_version").agg(
        (F.count("*") - 1).alias("refused")
    )
    return first.join(counts, ["period", "dataset_version"])


def table_counts(**tables: DataFrame) -> DataFrame:
    """Row count per named lineage table."""
    frames = [
        frame.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, frame in tables.items()
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out

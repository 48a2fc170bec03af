"""The daily decision: gates, plans, ranks and finalists with and without extended hours."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import selection
from tidemark.policies import FinalistPolicy, RankingWeights, StrategyPolicy


def _round(
    cohort: DataFrame,
    cash_usd: float | Column,
    policy: StrategyPolicy,
    weights: RankingWeights,
    finals: FinalistPolicy,
    kill_switch: bool,
    active_positions: int,
) -> tuple[DataFrame, DataFrame]:
    evaluated = selection.evaluate_candidates(
        cohort,
        cash_usd=cash_usd,
        policy=policy,
        kill_switch=kill_switch,
        active_positions=active_positions,
    )
    scored = selection.with_rank_score(evaluated, weights)
    return scored, selection.finalists(scored, finals)


def daily_decision(
    cohort: DataFrame,
    *,
    cash_usd: float | Column,
    policy: StrategyPolicy | None = None,
    weights: RankingWeights | None = None,
    finals: FinalistPolicy | None = None,
    kill_switch: bool = False,
    active_positions: int = 0,
) -> DataFrame:
    """One row per cohort candidate with its gate, plan, rank score and final flags.

    The same cohort is judged twice: with the extended-hours share and vetoes, and by
    regular-session evidence only. Finalists are at most five rows per session, so joining
    them back never grows with the cohort.
    """
    policy = policy or StrategyPolicy()
    weights = weights or RankingWeights()
    finals = finals or FinalistPolicy()
    options = (weights, finals, kill_switch, active_positions)
    full, best = _round(cohort, cash_usd, policy, *options)
    regular_cohort = cohort.drop("extended_gate_active")
    regular, regular_best = _round(
        regular_cohort, cash_usd, replace(policy, extended_score_share=0.0), *options
    )
    key = ["session", "symbol"]
    no = F.lit(False)
    return (
        full.join(
            best.select(*key, "final_rank", F.col("primary").alias("__primary")), key, "left"
        )
        .join(
            regular.select(
                *key,
                F.col("technical_score").alias("regular_only_technical_score"),
                F.col("rank_score").alias("regular_only_rank_score"),
            ),
            key,
            "left",
        )
        .join(regular_best.select(*key, F.col("primary").alias("__regular")), key, "left")
        .withColumns(
            {
                "finalist": F.col("__primary").isNotNull(),
                "primary": F.coalesce("__primary", no),
                "regular_only_finalist": F.col("__regular").isNotNull(),
                "regular_only_primary": F.coalesce("__regular", no),
            }
        )
        .drop("__primary", "__regular")
    )


#: How the universe names a sector that it does not know.
UNKNOWN_SECTOR = "UNKNOWN"


def session_verdict(decision: DataFrame) -> DataFrame:
    """TRADE with the primary symbol, or NO TRADE with the reason, per session."""
    return decision.groupBy("session").agg(
        F.max(F.when(F.col("primary"), F.col("symbol"))).alias("primary_symbol"),
        F.count_if("finalist").alias("finalists"),
        F.when(F.count_if("primary") > 0, "TRADE").otherwise("NO TRADE").alias("decision"),
        F.when(F.count_if("primary") == 0, selection.TOO_FEW_FINALISTS).alias("no_trade_reason"),
    )


def sector_peers(returns: DataFrame) -> DataFrame:
    """Mean return of the sector joined back to each symbol (symbol, sector, own_return).

    A symbol whose sector is not known has no peers, so its sector return is null.
    """
    named = returns.filter(F.upper(F.trim("sector")) != UNKNOWN_SECTOR)
    means = named.groupBy("sector").agg(F.avg("own_return").alias("sector_return"))
    return returns.join(means, "sector", "left")

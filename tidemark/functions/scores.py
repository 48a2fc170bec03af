"""Scores and plan geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numbers import clip, clip_known, positive
from tidemark.policies import RankingWeights, StrategyPolicy, UniversePolicy

# Fixed values ------------------------------------------------------------------------
UNIVERSE_WEIGHTS = {"liquidity": 0.45, "spread": 0.25, "opportunity": 0.15, "coverage": 0.15}
SCAN_WEIGHTS = {
    "liquidity": 0.20,
    "rvol": 0.20,
    "volume_acceleration": 0.10,
    "gap": 0.12,
    "gap_down_penalty": -0.08,
    "range": 0.15,
    "spread": 0.15,
    "relative_strength": 0.05,
    "premarket": 0.08,
}
DECISION_MINUTES, SESSION_MINUTES = 5, 390
MARKET_SCORE_SPAN = 0.08
OPTIONAL_COMPONENTS = ("news", "social", "fundamentals")
# -------------------------------------------------------------------------------------


def _log_share(value: Column, decades: float) -> Column:
    return clip_known(F.log10(F.greatest(F.lit(1.0), value)) / F.lit(decades))


def universe_score(policy: UniversePolicy) -> Column:
    """Monthly capacity score of a candidate; not the trading score."""
    w = UNIVERSE_WEIGHTS
    return F.round(
        w["liquidity"] * _log_share(F.col("median_dollar_volume"), 9.0)
        + w["spread"] * (1 - clip_known(F.col("spread_pct") / F.lit(policy.max_spread_pct)))
        + w["opportunity"] * clip_known(F.col("volatility") / F.lit(0.05))
        + w["coverage"] * F.col("coverage_ratio"),
        10,
    )


def scan_metrics() -> dict[str, Column]:
    """Discovery metrics of a scan quote; missing inputs stay missing.

    Inputs: last_trade_price, volume, average_daily_volume, previous_close, prior_volume,
    benchmark_return, sector_return.
    """
    volume = F.col("volume").cast("double")
    expected = F.col("average_daily_volume") * F.lit(DECISION_MINUTES / SESSION_MINUTES)
    prior = F.col("prior_volume").cast("double")
    own = F.col("last_trade_price") / positive(F.col("previous_close")) - 1
    usable = F.col("volume").isNotNull() & F.col("last_trade_price").isNotNull()
    market = own - F.col("benchmark_return")
    sector = own - F.col("sector_return")
    both = F.filter(F.array(market, sector), lambda v: v.isNotNull())
    relative = F.when(
        F.size(both) > 0, F.aggregate(both, F.lit(0.0), lambda a, b: a + b) / F.size(both)
    )
    return {
        "rvol": F.when(usable, volume / positive(expected)),
        "volume_acceleration": F.when(
            usable & (prior >= 0),
            F.greatest(F.lit(0.0), volume - prior) / F.greatest(F.lit(1.0), prior),
        ),
        "market_relative_strength": F.when(usable, market),
        "sector_relative_strength": F.when(usable, sector),
        "relative_strength": F.when(usable, relative),
        "directional_gap": F.when(usable, own),
    }


def usable_scan_quote() -> Column:
    fields = ("last_trade_price", "bid_price", "ask_price", "volume", "open_price", "high_price",
              "low_price")
    present = F.lit(True)
    for name in fields:
        present = present & F.col(name).isNotNull()
    prices = (
        (F.col("last_trade_price") > 0)
        & (F.col("open_price") > 0)
        & (F.col("bid_price") > 0)
        & (F.col("ask_price") >= F.col("bid_price"))
    )
    return F.coalesce(F.col("is_trade_eligible") & present & prices, F.lit(False))


def scan_components(max_spread_pct: float) -> dict[str, Column]:
    """The nine clipped parts of the discovery score, from quote and metric columns."""
    price, opened = F.col("last_trade_price"), F.col("open_price")
    midpoint = (F.col("bid_price") + F.col("ask_price")) / 2
    gap = F.coalesce(F.col("directional_gap"), price / opened - 1)
    zero, neutral = F.lit(0.0), F.lit(0.5)

    def step(value: Column) -> Column:
        return clip_known(F.greatest(zero, value) / F.lit(0.05))

    by_volume = F.when(
        F.col("premarket_volume").isNotNull(), _log_share(F.col("premarket_volume"), 8.0)
    )

    def neutral_if_unset(value: Column) -> Column:
        # A part of exactly zero counts as unset here.
        return F.when(value.isNull() | (value == 0), neutral).otherwise(value)

    by_gap = F.when(
        F.col("premarket_gap").isNotNull(),
        neutral_if_unset(by_volume) * 0.5 + step(F.col("premarket_gap")) * 0.5,
    ).otherwise(by_volume)
    premarket = F.when(
        F.col("premarket_range").isNotNull(),
        neutral_if_unset(by_gap) * 0.75 + clip_known(F.col("premarket_range") / F.lit(0.05)) * 0.25,
    ).otherwise(by_gap)
    return {
        "liquidity": _log_share(price * F.col("volume"), 9.0),
        "rvol": clip_known(F.coalesce(F.col("rvol"), F.lit(1.0)) / 4),
        "volume_acceleration": clip_known(
            F.coalesce(F.col("volume_acceleration"), F.lit(1.0)) / F.lit(0.03)
        ),
        "gap": step(gap),
        "gap_down_penalty": step(-gap),
        "range": clip_known(
            F.greatest(zero, F.col("high_price") - F.col("low_price")) / opened / F.lit(0.05)
        ),
        "spread": 1
        - clip_known((F.col("ask_price") - F.col("bid_price")) / midpoint / F.lit(max_spread_pct)),
        "relative_strength": clip_known(
            neutral + F.coalesce(F.col("relative_strength"), zero) * 10
        ),
        "premarket": F.coalesce(premarket, neutral),
    }


def scan_score(components: dict[str, Column]) -> Column:
    total = F.lit(0.0)
    for name, weight in SCAN_WEIGHTS.items():
        total = total + F.lit(weight) * components[name]
    return clip_known(F.round(total, 10))


def technical_score(extended_share: float) -> Column:
    """Monotone map of the raw composite to (0, 1), blended with the extended score."""
    raw = (
        (F.col("price") / F.col("vwap") - 1) * 100
        + (F.col("rvol") - 1)
        + F.col("market_relative_strength")
        + F.col("sector_relative_strength")
    )
    regular = F.lit(0.5) + raw / (2 * (1 + F.abs(raw)))
    share = F.lit(float(extended_share))
    return F.round(regular * (1 - share) + F.col("extended_score") * share, 10)


def effective_weights(weights: RankingWeights, scores: dict[str, Column]) -> dict[str, Column]:
    """Weights in use for a row: a missing optional component gives its weight to technical."""
    table = weights.as_dict()
    technical = F.lit(table["technical"])
    out: dict[str, Column] = {"market": F.lit(table["market"])}
    for name in OPTIONAL_COMPONENTS:
        missing = scores[name].isNull()
        technical = technical + F.when(missing, table[name]).otherwise(0.0)
        out[name] = F.when(missing, 0.0).otherwise(table[name])
    return {"technical": technical, **out}


def component_score(weights: RankingWeights, scores: dict[str, Column]) -> Column:
    """Weighted score of normalised components; the market component is required."""
    used = effective_weights(weights, scores)
    total = scores["technical"] * used["technical"] + scores["market"] * used["market"]
    for name in OPTIONAL_COMPONENTS:
        total = total + F.coalesce(scores[name], F.lit(0.0)) * used[name]
    return total


def market_score(own_return: Column, benchmark_return: Column) -> Column:
    return clip(F.lit(0.5) + (own_return - benchmark_return) / F.lit(MARKET_SCORE_SPAN))


def blended_market_score(own: Column, benchmark: Column, sector: Column) -> Column:
    """Equal blend of market- and sector-relative scores; sector may be missing."""
    against_market = market_score(own, benchmark)
    return F.when(sector.isNull(), against_market).otherwise(
        (against_market + market_score(own, sector)) / 2
    )


def position_size(cash: Column, entry: Column, stop: Column, max_risk: float) -> Column:
    """Whole shares that fit both the cash and the loss budget; 0 without positive risk."""
    risk = entry - stop
    return F.when(
        risk > 0, F.floor(F.least(cash / entry, F.lit(float(max_risk)) / positive(risk)))
    ).otherwise(F.lit(0)).cast("long")


def plan_geometry(policy: StrategyPolicy) -> dict[str, Column]:
    """Entry above and stop below the opening-range / VWAP pair."""
    upper = F.greatest("opening_range_high", "vwap")
    lower = F.least("opening_range_high", "vwap")
    entry = upper * F.lit(1 + policy.entry_buffer_pct)
    stop = lower * F.lit(1 - policy.stop_buffer_pct)
    return {
        "entry": entry,
        "stop": stop,
        "target": entry + (entry - stop) * F.lit(policy.reward_to_risk),
    }

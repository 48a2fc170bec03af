"""Scan scores, cohorts, hard gates, plans, ranking and finalists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numbers import clip, is_finite
from tidemark.functions.scores import (
    component_score,
    plan_geometry,
    position_size,
    scan_components,
    scan_score,
    technical_score,
    usable_scan_quote,
)
from tidemark.operators.ordering import position, rising
from tidemark.operators.scaling import settle
from tidemark.policies import (
    CohortPolicy,
    FinalistPolicy,
    RankingWeights,
    RiskPolicy,
    StrategyPolicy,
)

# Fixed values ------------------------------------------------------------------------
SCAN_PASSED, SCAN_INVALID = "passed broad scan gates", "invalid scan quote"
BUCKET_REASONS = {
    "core": "top-ranked valid symbol",
    "boundary": "valid symbol just below core cutoff",
    "diversity": "deterministic diversity sample",
}
GATES = (
    "non-finite market input",
    "stale market data",
    "delayed market data",
    "trading halt",
    "non-positive market price",
    "negative market measurement",
    "crossed market",
    "spread exceeds limit",
    "volatility exceeds limit",
    "relative volume below limit",
    "liquidity below limit",
    "entry does not fit cash-only account",
)
GATES_PASSED = "passed hard gates"
BAD_GEOMETRY = "invalid risk geometry or insufficient cash/risk budget"
KILL_SWITCH, POSITION_OPEN = "global kill switch is active", "active V1 position already exists"
TOO_FEW_FINALISTS = "fewer than minimum qualifying finalists"
ENTRY_VALID, WAIT, EXPIRY = "ENTRY_VALID", "WAIT", "END_OF_DAY"
VETOES = (
    "global kill switch active",
    "V1 already has an active position",
    "market data is not trustworthy",
    "symbol is halted",
    "spread unavailable or above limit",
    "volatility above limit",
    "liquidity/relative volume below limit",
    "price does not fit current cash",
)
TRIGGER_INVALID = "opening-range/VWAP trigger not valid"
NO_STOP_DISTANCE = "non-positive stop distance"
ZERO_SHARES = "risk/cash sizing yields zero shares"
CONTINUATION = "ORB/VWAP continuation valid"
CONTROLS = 3
# -------------------------------------------------------------------------------------


def score_scan(quotes: DataFrame, max_spread_pct: float) -> DataFrame:
    """Discovery score of every scan quote, with its parts; unusable quotes score 0."""
    parts = scan_components(max_spread_pct)
    valid = usable_scan_quote()
    named = {f"c_{name}": F.when(F.col("valid"), expr) for name, expr in parts.items()}
    frame = settle(quotes.withColumn("valid", valid), "valid").withColumns(named)
    frame = settle(frame, *named)
    score = scan_score({name: F.col(f"c_{name}") for name in parts})
    scored = frame.withColumns(
        {
            "score": F.coalesce(F.when(F.col("valid"), score), F.lit(0.0)),
            "reason": F.when(F.col("valid"), SCAN_PASSED).otherwise(
                F.coalesce(F.col("invalid_reason"), F.lit(SCAN_INVALID))
            ),
        }
    )
    return settle(scored, "score", "reason")


def build_cohort(
    candidates: DataFrame,
    policy: CohortPolicy,
    by: Sequence[str] = ("session",),
    *,
    given_order: str | None = None,
) -> DataFrame:
    """Core, boundary and hash-sampled diversity members per session.

    Input: session, symbol, rank_score, valid. The three picks are row_number limits, so
    each task sends at most the picked number of rows per session. `given_order` names a
    column that already ranks the rows (1 = best); diversity rows then keep their position.
    """
    by = list(by)
    name = F.upper(F.trim("symbol"))
    if given_order is None:
        unique = (
            candidates.filter(F.col("valid") & (name != "") & is_finite(F.col("rank_score")))
            .groupBy(*by, name.alias("symbol"))
            .agg(F.max("rank_score").alias("rank_score"))
        )
        order = [F.col("rank_score").desc(), F.col("symbol").asc()]
    else:
        unique = candidates.groupBy(*by, name.alias("symbol")).agg(
            F.min(given_order).alias("rank_score")
        )
        order = [F.col("rank_score").asc(), F.col("symbol").asc()]
        # A session has at most one row per listed symbol, so its window is bounded.
        unique = unique.withColumn(
            "__place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        )
    head = policy.core + policy.boundary
    top = (
        unique.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        .filter(F.col("rank") <= head)
        .select(
            *by,
            "symbol",
            "rank",
            F.when(F.col("rank") <= policy.core, "core").otherwise("boundary").alias("bucket"),
        )
    )
    key = F.sha2(F.concat_ws(":", F.col(by[0]).cast("string"), "symbol"), 256)
    drawn = Window.partitionBy(*by).orderBy("__key", "symbol")
    diversity = (
        unique.join(top.select(*by, "symbol"), [*by, "symbol"], "left_anti")
        .withColumn("__key", key)
        .withColumn("rank", F.row_number().over(drawn))
        .filter(F.col("rank") <= policy.diversity)
        .select(
            *by,
            "symbol",
            (F.col("rank") + head if given_order is None else F.col("__place")).alias("rank"),
            F.lit("diversity").alias("bucket"),
        )
    )
    members = top.unionByName(diversity)
    reason = F.lit(None).cast("string")
    for bucket, text in BUCKET_REASONS.items():
        reason = F.when(F.col("bucket") == bucket, text).otherwise(reason)
    return members.withColumn("reason", reason)


def cohort_shortfall(cohort: DataFrame, policy: CohortPolicy, by: Sequence[str] = ("session",)) -> DataFrame:
    return cohort.groupBy(*by).agg(
        F.greatest(F.lit(0), F.lit(policy.target) - F.count("*")).cast("int").alias("shortfall")
    )


def spread_of(bid: Column, ask: Column) -> Column:
    """Spread over midpoint, null without a usable two-sided quote."""
    return F.when((bid > 0) & (ask >= bid), (ask - bid) / ((ask + bid) / 2))


def hard_gate_reason(cash: Column, policy: StrategyPolicy) -> Column:
    """First failed gate of a candidate, null when all pass."""
    inputs = (
        "price", "bid", "ask", "rvol", "volatility", "vwap", "opening_range_high", "volume",
        "market_relative_strength", "sector_relative_strength", "extended_score",
    )
    finite = F.lit(True)
    for name in inputs:
        finite = finite & is_finite(F.col(name))
    veto = F.when(F.col("extended_gate_active"), F.get("extended_vetoes", F.lit(0)))
    bid, ask = F.col("bid"), F.col("ask")
    rules = (
        ~F.col("fresh"),
        F.col("delayed"),
        F.col("halted"),
        F.least("price", "bid", "ask", "vwap", "opening_range_high") <= 0,
        (F.col("volume") < 0) | (F.col("rvol") < 0) | (F.col("volatility") < 0),
        ask < bid,
        (ask - bid) / F.nullif((ask + bid) / 2, F.lit(0.0)) > policy.max_spread_pct,
        F.col("volatility") > policy.max_volatility,
        F.col("rvol") < policy.min_rvol,
        F.col("volume") < policy.min_volume,
        F.greatest("opening_range_high", "vwap") * F.lit(1 + policy.entry_buffer_pct) > cash,
    )
    reason = F.when(~finite, GATES[0]).when(veto.isNotNull(), veto)
    for rule, text in zip(rules, GATES[1:]):
        reason = reason.when(rule, text)
    return reason


def with_strategy_inputs(df: DataFrame) -> DataFrame:
    """Fill the optional strategy inputs a candidate table may lack with their neutral values."""
    neutral: dict[str, Column] = {
        "market_relative_strength": F.lit(0.0),
        "sector_relative_strength": F.lit(0.0),
        "fresh": F.lit(True),
        "delayed": F.lit(False),
        "halted": F.lit(False),
        "extended_score": F.lit(0.5),
        "extended_vetoes": F.array().cast("array<string>"),
        "extended_gate_active": F.lit(False),
    }
    return df.withColumns({k: v for k, v in neutral.items() if k not in df.columns})


def evaluate_candidates(
    candidates: DataFrame,
    *,
    cash_usd: float | Column,
    policy: StrategyPolicy,
    kill_switch: bool = False,
    active_positions: int = 0,
) -> DataFrame:
    """Gate, plan and technical score per candidate, row by row (no shuffle)."""
    cash = cash_usd if isinstance(cash_usd, Column) else F.lit(float(cash_usd))
    frame = with_strategy_inputs(candidates)
    if kill_switch or active_positions:
        blocked = KILL_SWITCH if kill_switch else POSITION_OPEN
        gate = F.lit(blocked)
    else:
        gate = hard_gate_reason(cash, policy)
    frame = settle(
        frame.withColumn("__gate", gate).withColumns(plan_geometry(policy)),
        "__gate", "entry", "stop", "target",
    )
    quantity = position_size(cash, F.col("entry"), F.col("stop"), policy.max_risk_usd)
    frame = frame.withColumn("quantity", F.when(F.col("__gate").isNull(), quantity))
    bad = F.coalesce((F.col("entry") <= F.col("stop")) | (F.col("quantity") < 1), F.lit(True))
    frame = frame.withColumn(
        "reason",
        F.when(F.col("__gate").isNotNull(), F.col("__gate"))
        .when(bad, BAD_GEOMETRY)
        .otherwise(GATES_PASSED),
    ).withColumn("eligible", F.col("reason") == GATES_PASSED)
    frame = settle(frame, "quantity", "reason", "eligible")
    ok = F.col("eligible")
    planned = frame.withColumns(
        {
            "technical_score": F.when(ok, technical_score(policy.extended_score_share)),
            "plan_status": F.when(
                ok, F.when(F.col("price") >= F.col("entry"), ENTRY_VALID).otherwise(WAIT)
            ),
            "entry": F.when(ok, F.col("entry")),
            "stop": F.when(ok, F.col("stop")),
            "target": F.when(ok, F.col("target")),
            "quantity": F.when(ok, F.col("quantity")),
        }
    ).drop("__gate")
    return settle(planned, "technical_score", "plan_status", "entry", "stop", "target", "quantity")


def multi_veto(
    candidates: DataFrame,
    *,
    cash_usd: float,
    policy: RiskPolicy,
    kill_switch: bool = False,
    active_position: bool = False,
    require_spread: bool = True,
) -> DataFrame:
    """The variant that lists every veto, then checks the continuation trigger."""
    spread = spread_of(F.col("bid"), F.col("ask"))
    rules = (
        F.lit(kill_switch),
        F.lit(active_position),
        ~F.col("fresh") | F.col("delayed"),
        F.col("halted"),
        (spread.isNull() & F.lit(require_spread)) | (spread > policy.max_spread_pct),
        F.col("volatility") > policy.max_volatility,
        (F.col("volume") < policy.min_volume) | (F.col("rvol") < policy.min_rvol),
        F.col("price") > cash_usd,
    )
    vetoes = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(rule, F.lit(False)), F.lit(text))
                for rule, text in zip(rules, VETOES)
            ]
        )
    )
    price, stop = F.col("price"), F.greatest("vwap", "opening_range_low")
    risk = price - stop
    quantity = position_size(F.lit(float(cash_usd)), price, stop, policy.max_risk_usd)
    trigger = (price > F.col("vwap")) & (price >= F.col("opening_range_high"))
    frame = candidates.withColumn("__vetoes", vetoes)
    reasons = (
        F.when(F.size("__vetoes") > 0, F.col("__vetoes"))
        .when(~trigger, F.array(F.lit(TRIGGER_INVALID)))
        .when(risk <= 0, F.array(F.lit(NO_STOP_DISTANCE)))
        .when(quantity < 1, F.array(F.lit(ZERO_SHARES)))
        .otherwise(F.array(F.lit(CONTINUATION)))
    )
    frame = frame.withColumn("reasons", reasons).withColumn(
        "eligible", F.get("reasons", F.lit(0)) == CONTINUATION
    )
    ok = F.col("eligible")
    return frame.withColumns(
        {
            "score": F.when(ok, clip((F.col("rvol") - 1) / 3)).otherwise(F.lit(0.0)),
            "entry": F.when(ok, price),
            "stop": F.when(ok, stop),
            "target": F.when(ok, price + F.lit(policy.reward_risk) * risk),
            "quantity": F.when(ok, quantity),
            "max_loss": F.when(ok, quantity * risk),
        }
    ).drop("__vetoes")


def component_columns() -> dict[str, Column]:
    """Named components of a candidate row; the technical one is clipped."""
    return {
        "technical": clip(F.col("technical_score")),
        "market": F.col("market_score"),
        "news": F.col("news_score"),
        "social": F.col("social_score"),
        "fundamentals": F.col("fundamental_score"),
    }


def with_rank_score(df: DataFrame, weights: RankingWeights, name: str = "rank_score") -> DataFrame:
    score = component_score(weights, component_columns())
    return settle(df.withColumn(name, F.when(F.col("eligible"), score)), name)


def rank_order(score: str = "rank_score") -> list[Column]:
    """Eligible first, best score first, then symbol."""
    return [
        F.col("eligible").desc(),
        F.col(score).desc_nulls_last(),
        F.upper("symbol").asc(),
    ]


def rank_along() -> Column:
    """A long that never falls in `rank_order`: eligible rows first, then by falling score."""
    first = F.when(F.col("eligible"), F.lit(0)).when(~F.col("eligible"), F.lit(1)).otherwise(F.lit(2))
    # A score's long is within 2^41 of zero.
    return first.cast("long") * (1 << 43) - rising(F.col("rank_score"))


def rank_all(df: DataFrame, weights: RankingWeights, by: Sequence[str] = ("session",)) -> DataFrame:
    """Position of every candidate in its session."""
    return position(with_rank_score(df, weights), list(by), rank_order(), along=rank_along(), name="rank")


def shortlist(
    df: DataFrame, weights: RankingWeights, limit: int = 5, by: Sequence[str] = ("session",)
) -> DataFrame:
    """Best eligible candidates; the limit is applied inside each task first."""
    if not 1 <= limit <= 5:
        raise ValueError("shortlist limit must be between 1 and 5")
    scored = with_rank_score(df.filter("eligible"), weights)
    w = Window.partitionBy(*by).orderBy(*rank_order())
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def finalists(
    evaluated: DataFrame,
    policy: FinalistPolicy,
    by: Sequence[str] = ("session",),
    *,
    score: str = "rank_score",
) -> DataFrame:
    """Up to `maximum` qualifying plans per session; none when fewer than `minimum`."""
    passed = evaluated.filter("eligible")
    if policy.minimum_rank_score is not None and score == "rank_score":
        passed = passed.filter(F.col(score) >= policy.minimum_rank_score)
    order = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.upper("symbol"))
    best = passed.withColumn("final_rank", F.row_number().over(order)).filter(
        F.col("final_rank") <= policy.maximum
    )
    return (
        best.withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
        .filter(F.col("__n") >= policy.minimum)
        .withColumn("primary", F.col("final_rank") == 1)
        .drop("__n")
    )


def weight_ablation(
    df: DataFrame, weights: RankingWeights, by: Sequence[str] = ("session",)
) -> DataFrame:
    """Rank of every candidate under the baseline and with one optional weight removed."""
    variants = {
        "baseline": weights,
        "no_news": weights.without("news"),
        "no_social": weights.without("social"),
        "no_fundamentals": weights.without("fundamentals"),
    }
    parts = component_columns()
    scores = F.array(
        *[
            F.struct(
                F.lit(name).alias("variant"),
                F.when(F.col("eligible"), component_score(variant, parts)).alias("rank_score"),
            )
            for name, variant in variants.items()
        ]
    )
    cells = df.select(*by, "symbol", "eligible", F.explode(scores).alias("__v")).select(
        *by, "symbol", "eligible", "__v.variant", "__v.rank_score"
    )
    return position(cells, [*by, "variant"], rank_order(), along=rank_along(), name="rank")


def role(primary: Column, finalist: Column, other: str = "CONTROL") -> Column:
    return (
        F.when(F.coalesce(primary, F.lit(False)), "PRIMARY")
        .when(F.coalesce(finalist, F.lit(False)), "FINALIST")
        .otherwise(other)
    )


def selection_explanations(
    ranked: DataFrame, by: Sequence[str] = ("session",), controls: int = CONTROLS
) -> DataFrame:
    """Finalists and the best non-finalist controls of sessions that have finalists.

    `ranked` carries eligible, rank_score, finalist, primary and decision_price. Ranks are
    over all eligible rows with a usable score; both picks are row_number limits.
    """
    by = list(by)
    usable = ranked.filter(F.col("eligible") & is_finite(F.col("rank_score")))
    picks = position(
        usable, by, [F.col("rank_score").desc(), F.col("symbol").asc()],
        along=-rising(F.col("rank_score")), name="final_rank",
    )
    winners = picks.filter("finalist")
    nearest = Window.partitionBy(*by).orderBy("final_rank")
    others = (
        picks.filter(~F.col("finalist"))
        .withColumn("__rn", F.row_number().over(nearest))
        .filter(F.col("__rn") <= controls)
    )
    chosen = winners.withColumn("__rn", F.lit(0)).unionByName(others)
    return (
        chosen.join(winners.select(*by).distinct(), by, "left_semi")
        .filter(is_finite(F.col("decision_price")) & (F.col("decision_price") > 0))
        .withColumn("role", role(F.col("primary"), F.col("finalist")))
        .drop("__rn")
    )

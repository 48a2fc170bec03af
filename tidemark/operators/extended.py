"""Pre- and post-market evidence: phase metrics, cross-sectional scores, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.calendar import POST_MARKET, PRE_MARKET, REGULAR, session_phase
from tidemark.operators.ordering import dense_position
from tidemark.operators.scaling import settle
from tidemark.policies import ExtendedThresholds

# Fixed values ------------------------------------------------------------------------
EXTENDED_FEATURE_VERSION = "extended-v1"
SCORED_METRICS = ("active_minutes", "dollar_volume", "return_pct", "range_pct", "volatility")
LOWER_IS_BETTER = ("range_pct", "volatility")
PRE_UNAVAILABLE = "required pre-market evidence unavailable"
PRE_REASONS = (
    "pre-market active minutes below limit",
    "pre-market dollar volume below limit",
    "pre-market absolute return above limit",
    "pre-market absolute gap above limit",
    "pre-market instability above limit",
)
POST_REASONS = (
    "prior post-market active minutes below limit",
    "prior post-market dollar volume below limit",
    "prior post-market absolute return above limit",
    "prior post-market instability above limit",
)
# -------------------------------------------------------------------------------------

KEY = ["symbol", "session_date"]


def phase_metrics(bars: DataFrame) -> DataFrame:
    """Metrics per (symbol, session, phase) from valid minute bars.

    One bar per start is required, so a (symbol, session, phase) window holds at most the
    minutes of one phase. The gap needs another session's close; see `with_gap`.
    """
    labelled = settle(bars.withColumn("phase", session_phase(F.col("start"))), "phase")
    frame = labelled.filter("phase IS NOT NULL")
    w = Window.partitionBy(*KEY, "phase").orderBy("start")
    frame = frame.withColumn("__ret", F.col("close") / F.lag("close").over(w) - 1)
    out = frame.groupBy(*KEY, "phase").agg(
        F.count("*").alias("active_minutes"),
        F.sum(F.col("close") * F.col("volume")).alias("dollar_volume"),
        F.min_by("open", "start").alias("first_open"),
        F.max_by("close", "start").alias("last_close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.sum("volume").cast("long").alias("volume"),
        F.coalesce(F.stddev_pop("__ret"), F.lit(0.0)).alias("volatility"),
        F.min("start").alias("first_observed_at"),
        F.max("start").alias("last_observed_at"),
    )
    return out.withColumns(
        {
            "return_pct": F.col("last_close") / F.col("first_open") - 1,
            "range_pct": F.col("high") / F.col("low") - 1,
        }
    )


def regular_close(bars: DataFrame) -> DataFrame:
    """Last regular-session close of every (symbol, session)."""
    return (
        bars.filter(session_phase(F.col("start")) == REGULAR)
        .groupBy(*KEY)
        .agg(F.max_by("close", "start").alias("regular_close"))
    )


def with_gap(metrics: DataFrame, calendar: DataFrame) -> DataFrame:
    """Add the pre-market gap against the previous session's last regular close."""
    closes = metrics.filter(F.col("phase") == REGULAR).select(
        "symbol",
        F.col("session_date").alias("previous_session"),
        F.col("last_close").alias("previous_close"),
    )
    sessions = calendar.select(F.col("session").alias("session_date"), "previous_session")
    return (
        metrics.join(sessions, "session_date")
        .join(closes, ["symbol", "previous_session"], "left")
        .withColumn(
            "gap_pct",
            F.when(
                F.col("phase") == PRE_MARKET, F.col("last_close") / F.col("previous_close") - 1
            ),
        )
        .drop("previous_session")
    )


_METRICS = [
    "active_minutes", "dollar_volume", "return_pct", "range_pct", "volatility", "high", "low",
    "volume", "first_observed_at", "last_observed_at", "last_close",
]


def session_evidence(metrics: DataFrame, calendar: DataFrame) -> DataFrame:
    """Today's pre-market next to the previous session's post-market, per symbol.

    Each phase row is sent to the session that may use it: pre-market to its own session,
    regular close and post-market to the next one. One aggregation then gathers a session's
    evidence, without joining the metrics to themselves, and no row can reach its own
    session's decision with its own after-hours trading.
    """
    sessions = calendar.select(
        F.col("session").alias("session_date"), "previous_session", "next_session"
    )
    own = F.struct(F.col("session_date").alias("day"), F.lit(True).alias("own"))
    later = F.struct(F.col("next_session").alias("day"), F.lit(False).alias("own"))
    sent = (
        metrics.join(sessions.drop("previous_session"), "session_date")
        .select(
            "symbol",
            "phase",
            F.struct(*_METRICS).alias("m"),
            F.inline(
                F.when(F.col("phase") == PRE_MARKET, F.array(own)).otherwise(F.array(own, later))
            ),
        )
        .filter(F.col("day").isNotNull())
    )

    def only(phase: str, is_own: bool) -> Column:
        return F.max(F.when((F.col("phase") == phase) & (F.col("own") == is_own), F.col("m")))

    gathered = (
        sent.groupBy("symbol", F.col("day").alias("session_date"))
        .agg(
            F.bool_or("own").alias("__own"),
            only(PRE_MARKET, True).alias("__pre"),
            only(REGULAR, False).alias("__regular"),
            only(POST_MARKET, False).alias("postmarket"),
        )
        .filter("__own")
        .join(sessions.drop("next_session"), "session_date")
    )
    gap = F.col("__pre.last_close") / F.col("__regular.last_close") - 1
    return (
        gathered.withColumn(
            "premarket",
            F.when(
                F.col("__pre").isNotNull() & gap.isNotNull(),
                F.col("__pre").withField("gap_pct", gap),
            ),
        )
        .select(*KEY, "previous_session", "premarket", "postmarket")
        .withColumns(
            {
                "premarket_unavailable_reason": F.when(
                    F.col("premarket").isNull(), "same-day pre-market evidence unavailable"
                ),
                "postmarket_unavailable_reason": F.when(
                    F.col("postmarket").isNull(), "prior post-market evidence unavailable"
                ),
                "feature_version": F.lit(EXTENDED_FEATURE_VERSION),
            }
        )
    )


def evidence_problem() -> Column:
    """Broken availability or leakage rule of a session-evidence row, null when sound."""
    pre, post = F.col("premarket"), F.col("postmarket")
    return (
        F.when(
            F.col("previous_session") >= F.col("session_date"),
            "post-market evidence must precede the decision session",
        )
        .when(
            pre.isNull() != F.col("premarket_unavailable_reason").isNotNull(),
            "pre-market availability and reason disagree",
        )
        .when(pre.isNotNull() & F.col("premarket.gap_pct").isNull(), "pre-market gap is required")
        .when(
            post.isNull() != F.col("postmarket_unavailable_reason").isNotNull(),
            "post-market availability and reason disagree",
        )
    )


def extended_scores(evidence: DataFrame) -> DataFrame:
    """Cross-sectional score per session: mean dense-rank position of each metric.

    Metrics are unpivoted, ranked over their distinct values (a range-partitioned ranking,
    so a session with very many symbols is spread over tasks), and averaged per phase; a
    missing phase counts 0.5.
    """

    def cells_of(phase: str, metrics: list[str]) -> Column:
        cells = F.array(
            *[
                F.struct(
                    F.lit(phase).alias("phase"),
                    F.lit(f"{phase}.{name}").alias("metric"),
                    F.col(f"{phase}.{name}").cast("double").alias("value"),
                )
                for name in metrics
            ]
        )
        return F.filter(cells, lambda cell: cell["value"].isNotNull())

    every = F.concat(
        cells_of("premarket", [*SCORED_METRICS, "gap_pct"]),
        cells_of("postmarket", list(SCORED_METRICS)),
    )
    # inline_outer keeps a row for keys without any evidence.
    cells = evidence.select(*KEY, F.inline_outer(every))
    group = ["session_date", "metric"]
    ranks = dense_position(cells, group, "value")
    place = F.col("dense_rank") / (F.col("distinct_values") - 1)
    inverted = F.substring_index("metric", ".", -1).isin(*LOWER_IS_BETTER)
    score = (
        F.when(F.col("distinct_values") == 1, F.lit(0.5))
        .when(inverted, 1 - place)
        .otherwise(place)
    )
    scored = cells.join(ranks, [*group, "value"], "left").withColumn("score", score)
    half = F.lit(0.5)
    by_phase = scored.groupBy(*KEY).agg(
        F.coalesce(F.avg(F.when(F.col("phase") == "premarket", F.col("score"))), half).alias(
            "premarket_score"
        ),
        F.coalesce(F.avg(F.when(F.col("phase") == "postmarket", F.col("score"))), half).alias(
            "postmarket_score"
        ),
    )
    return by_phase.withColumn(
        "extended_score", (F.col("premarket_score") + F.col("postmarket_score")) / 2
    )


def extended_gate_reasons(thresholds: ExtendedThresholds) -> Column:
    """All veto reasons of a session-evidence row, in rule order."""
    t = thresholds

    def pre(name: str) -> Column:
        return F.col(f"premarket.{name}")

    def post(name: str) -> Column:
        return F.col(f"postmarket.{name}")

    before = [
        pre("active_minutes") < t.min_pre_active_minutes,
        pre("dollar_volume") < t.min_pre_dollar_volume,
        F.abs(pre("return_pct")) > t.max_pre_abs_return,
        F.abs(pre("gap_pct")) > t.max_pre_abs_gap,
        (pre("range_pct") > t.max_pre_range) | (pre("volatility") > t.max_pre_volatility),
    ]
    after = [
        post("active_minutes") < t.min_post_active_minutes,
        post("dollar_volume") < t.min_post_dollar_volume,
        F.abs(post("return_pct")) > t.max_post_abs_return,
        (post("range_pct") > t.max_post_range) | (post("volatility") > t.max_post_volatility),
    ]
    reasons = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(rule, F.lit(False)), F.lit(text))
                for rule, text in zip((*before, *after), (*PRE_REASONS, *POST_REASONS))
            ]
        )
    )
    return F.when(F.col("premarket").isNull(), F.array(F.lit(PRE_UNAVAILABLE))).otherwise(reasons)


def premarket_distance(price: Column) -> dict[str, Column]:
    """Distance of the current price from the pre-market extremes."""
    high, low = F.col("premarket.high"), F.col("premarket.low")
    return {
        "distance_from_high_pct": F.when(high > 0, price / high - 1),
        "distance_from_low_pct": F.when(low > 0, price / low - 1),
    }

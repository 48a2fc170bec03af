"""First-touch outcomes of trade plans over bars, fills and execution costs.

A plan meets the bars of one symbol and session; bars are unique per start, so a plan sees
at most one bar per minute of a day. All windows here are partitioned by that bounded group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.segments import Segmentation
from tidemark.policies import ExecutionProfile

# Fixed values ------------------------------------------------------------------------
AMBIGUOUS = "ambiguous_same_bar"
STOP_FIRST = "stop_before_target"
TARGET_FIRST = "target_before_stop"
END_OF_DAY = "eod"
NO_TRIGGER = "no_trigger"
FIDELITY = "BAR_ONLY"
KNOWN_FIDELITIES = ("BAR_ONLY", "QUOTE_AWARE", "CONTEXT_AWARE", "FORWARD_LIVE")
NO_PLAN = "candidate had no eligible trade plan"
NO_BARS = "no stored post-decision one-minute bars"
REFERENCE_MINUTES = (5, 15, 30, 60)
# -------------------------------------------------------------------------------------

PLAN_KEY = ["snapshot_id", "symbol"]


def adjusted_buy(price: Column, profile: ExecutionProfile) -> Column:
    return price * F.lit(1 + profile.slippage_bps / 10_000)


def adjusted_sell(price: Column, profile: ExecutionProfile) -> Column:
    return price * F.lit(1 - profile.slippage_bps / 10_000)


def filled_quantity(requested: Column, profile: ExecutionProfile) -> Column:
    return F.floor(requested * F.lit(float(profile.fill_ratio))).cast("long")


def round_trip_cost(
    entry: Column, exit_price: Column, quantity: Column, profile: ExecutionProfile
) -> Column:
    """Slippage on both sides, two commissions, and the currency fee on the notional."""
    slip = (
        adjusted_buy(entry, profile) - entry + exit_price - adjusted_sell(exit_price, profile)
    ) * quantity
    cost = slip + F.lit(2.0 * profile.commission_per_order)
    if profile.fx_rate is not None and profile.fx_fee_bps:
        cost = cost + (entry + exit_price) * quantity * F.lit(
            profile.fx_rate * profile.fx_fee_bps / 10_000
        )
    return cost


def plan_problem() -> Column:
    """Code of what keeps a plan from being evaluated, null when nothing does."""
    prices = F.least("entry", "stop", "target")
    codes = {
        "plan:gap": F.greatest(*[F.col(name).isNull() for name in ("entry", "stop", "target", "quantity")]),
        "plan:size": (prices <= 0) | (F.col("quantity") < 1),
        "plan:stop": F.col("stop") >= F.col("entry"),
        "plan:target": F.col("target") <= F.col("entry"),
    }
    return F.coalesce(*[F.when(test, F.lit(code)) for code, test in codes.items()])


def barrier_outcomes(plans: DataFrame, bars: DataFrame, *, shadow: bool = False) -> DataFrame:
    """Trigger, exit and excursions of each plan by first touch.

    The trigger is the first bar from `valid_from` to `expires_at` with high >= entry. If
    that bar also touches the stop the order inside it is unknown: ambiguous, without
    excursions. Otherwise the exit is the first bar from the trigger on that touches the
    stop or target (both: ambiguous), else the last close. `shadow` ignores `expires_at`
    (the plan lives until the last bar), drops bars before `valid_from`, and adds the path
    summary over the rest of the session, past the exit.
    """
    path = plans.join(
        bars.select("symbol", "session_date", F.col("start").alias("ts"), "high", "low", "close"),
        ["symbol", "session_date"],
    )
    if shadow:
        path = path.filter(F.col("ts") >= F.col("valid_from"))
    plan_columns = [name for name in plans.columns if name not in PLAN_KEY]
    whole = Window.partitionBy(*PLAN_KEY)
    ts, high, low = F.col("ts"), F.col("high"), F.col("low")
    can_trigger = (ts >= F.col("valid_from")) & (high >= F.col("entry"))
    if not shadow:
        can_trigger = can_trigger & (ts <= F.col("expires_at"))
    path = path.withColumn("trigger_at", F.min(F.when(can_trigger, ts)).over(whole))
    active = F.col("trigger_at").isNotNull() & (ts >= F.col("trigger_at"))
    hit_stop, hit_target = low <= F.col("stop"), high >= F.col("target")
    path = path.withColumn(
        "touch_at", F.min(F.when(active & (hit_stop | hit_target), ts)).over(whole)
    )
    held = active & (F.col("touch_at").isNull() | (ts <= F.col("touch_at")))
    at_touch = ts == F.col("touch_at")
    at_trigger = ts == F.col("trigger_at")
    aggregates = [
        *[F.first(name).alias(name) for name in plan_columns],
        F.first("trigger_at").alias("trigger_at"),
        F.first("touch_at").alias("touch_at"),
        F.bool_or(at_trigger & hit_stop).alias("__trigger_stop"),
        F.bool_or(at_touch & hit_stop).alias("__stop"),
        F.bool_or(at_touch & hit_target).alias("__target"),
        F.max(F.when(held, high)).alias("__high"),
        F.min(F.when(held, low)).alias("__low"),
        F.max_by("close", ts).alias("last_close"),
        F.max(ts).alias("last_at"),
    ]
    if shadow:
        scope = active | F.col("trigger_at").isNull()
        first_tie = F.unix_micros(ts)
        aggregates += [
            F.max_by(
                F.struct(F.col("high").alias("price"), F.col("ts").alias("at")),
                F.when(scope, F.struct(high, -first_tie)),
            ).alias("__favorable"),
            F.min_by(
                F.struct(F.col("low").alias("price"), F.col("ts").alias("at")),
                F.when(scope, F.struct(low, first_tie)),
            ).alias("__adverse"),
            F.min(F.when(active & hit_target, ts)).alias("target_at"),
            F.min(F.when(active & hit_stop, ts)).alias("stop_at"),
            F.min_by("close", ts).alias("first_close"),
        ]
    out = path.groupBy(*PLAN_KEY).agg(*aggregates)
    triggered = F.col("trigger_at").isNotNull()
    same_bar = F.col("__trigger_stop")
    outcome = (
        F.when(~triggered, NO_TRIGGER)
        .when(same_bar | (F.col("__stop") & F.col("__target")), AMBIGUOUS)
        .when(F.col("__stop"), STOP_FIRST)
        .when(F.col("__target"), TARGET_FIRST)
        .otherwise(END_OF_DAY)
    )
    out = out.withColumn("outcome", outcome).withColumns(
        {
            "triggered": triggered,
            "mfe": F.when(~triggered | same_bar, 0.0).otherwise(
                F.greatest(F.lit(0.0), F.col("__high") - F.col("entry"))
            ),
            "mae": F.when(~triggered | same_bar, 0.0).otherwise(
                F.greatest(F.lit(0.0), F.col("entry") - F.col("__low"))
            ),
            "exit_price": F.when(F.col("outcome") == STOP_FIRST, F.col("stop"))
            .when(F.col("outcome") == TARGET_FIRST, F.col("target"))
            .when(F.col("outcome") == END_OF_DAY, F.col("last_close")),
            "exit_at": F.when(~triggered, F.lit(None).cast("timestamp"))
            .when(same_bar, F.col("trigger_at"))
            .when(F.col("outcome") == END_OF_DAY, F.col("last_at"))
            .otherwise(F.col("touch_at")),
        }
    )
    if shadow:
        out = out.withColumns(
            {
                "max_favorable_price": F.col("__favorable.price"),
                "max_favorable_at": F.col("__favorable.at"),
                "max_adverse_price": F.col("__adverse.price"),
                "max_adverse_at": F.col("__adverse.at"),
            }
        )
    return out.drop(
        "__trigger_stop", "__stop", "__target", "__high", "__low", "__favorable", "__adverse",
        "touch_at",
    )


def shadow_outcomes(
    plans: DataFrame, bars: DataFrame, profile: ExecutionProfile | None = None
) -> DataFrame:
    """Full outcome rows, one per plan; plans without bars or prices are unavailable."""
    profile = profile or ExecutionProfile()
    usable = plans.filter(F.col("entry").isNotNull() & plan_problem().isNull())
    walked = barrier_outcomes(usable, bars, shadow=True)
    entry, quantity = F.col("entry"), F.col("quantity")
    shadow_return = F.when(F.col("triggered"), (F.col("exit_price") - entry) / entry)
    seconds = lambda late, early: (
        (F.unix_micros(late) - F.unix_micros(early)) / F.lit(1_000_000)
    )
    valued = walked.withColumn("shadow_return", shadow_return).withColumns(
        {
            "execution_cost": F.when(
                F.col("shadow_return").isNotNull(),
                round_trip_cost(entry, F.col("exit_price"), quantity, profile),
            ),
            "shadow_pnl": quantity * entry * F.col("shadow_return"),
        }
    )
    valued = valued.withColumn("net_pnl", F.col("shadow_pnl") - F.col("execution_cost"))
    rows = valued.select(
        *PLAN_KEY,
        "outcome",
        F.col("triggered").alias("entry_triggered"),
        (F.col("outcome") == TARGET_FIRST).alias("target_before_stop"),
        (F.col("outcome") == STOP_FIRST).alias("stop_before_target"),
        F.col("target_at").isNotNull().alias("target_hit"),
        F.col("stop_at").isNotNull().alias("stop_hit"),
        "mfe",
        "mae",
        (F.col("mfe") / entry).alias("mfe_pct"),
        (F.col("mae") / entry).alias("mae_pct"),
        "max_favorable_price",
        "max_favorable_at",
        "max_adverse_price",
        "max_adverse_at",
        F.col("trigger_at").alias("entry_at"),
        "target_at",
        "stop_at",
        seconds("trigger_at", "valid_from").alias("time_to_entry_seconds"),
        seconds("target_at", "trigger_at").alias("time_to_target_seconds"),
        seconds("stop_at", "trigger_at").alias("time_to_stop_seconds"),
        "exit_price",
        "exit_at",
        "shadow_return",
        "shadow_pnl",
        "execution_cost",
        "net_pnl",
        (F.col("net_pnl") / (quantity * entry)).alias("net_return"),
        F.coalesce(F.when(F.col("triggered"), entry), F.col("first_close")).alias("baseline"),
        F.coalesce("trigger_at", "valid_from").alias("baseline_at"),
        F.col("last_close"),
    )
    return (
        plans.select(*PLAN_KEY, "session_date", F.col("entry").alias("__entry"))
        .join(rows, PLAN_KEY, "left")
        .withColumns(
            {
                "status": F.when(F.col("outcome").isNull(), "unavailable").otherwise("complete"),
                "reason": F.when(F.col("__entry").isNull(), NO_PLAN).when(
                    F.col("outcome").isNull(), NO_BARS
                ),
                "fidelity": F.lit(FIDELITY),
                "eod_return": (F.col("last_close") - F.col("baseline")) / F.col("baseline"),
            }
        )
        .drop("__entry")
    )


def reference_returns(
    starts: DataFrame,
    bars: DataFrame,
    offsets: Sequence[int] = REFERENCE_MINUTES,
    segmentation: Segmentation | None = None,
) -> DataFrame:
    """Return from a baseline to the first bar at or after each offset.

    `starts`: snapshot_id, symbol, session_date, baseline, baseline_at. One row per start
    and offset; null when the session has no later bar.
    """
    marks = starts.select(
        *PLAN_KEY,
        "session_date",
        "baseline",
        F.col("baseline_at"),
        F.explode(F.array(*[F.lit(int(m)) for m in offsets])).alias("minutes"),
    ).withColumn(
        "__due", F.timestamp_micros(F.unix_micros("baseline_at") + F.col("minutes").cast("long") * 60_000_000)
    )
    found = asof_join(
        marks,
        bars.select(
            "symbol", "session_date", F.col("start").alias("bar_at"), F.col("close").alias("__c")
        ),
        by=["symbol", "session_date"],
        left_time="__due",
        right_time="bar_at",
        values=["__c"],
        direction="forward",
        segmentation=segmentation,
    )
    return found.select(
        *PLAN_KEY,
        "minutes",
        "bar_at",
        ((F.col("__c") - F.col("baseline")) / F.col("baseline")).alias("reference_return"),
    )


def manual_fills(
    signals: DataFrame,
    observations: DataFrame,
    profile: ExecutionProfile,
    *,
    segmentation: Segmentation | None = None,
) -> DataFrame:
    """First observable price at or after the signal plus latency, adjusted for slippage.

    `signals`: signal_id, symbol, session_date, signal_at, side; `observations`: symbol,
    session_date, observed_at, price.
    """
    latency = int(profile.manual_latency_seconds * 1_000_000)
    ready = signals.withColumn(
        "__ready", F.timestamp_micros(F.unix_micros("signal_at") + F.lit(latency))
    )
    found = asof_join(
        ready,
        observations.select(
            "symbol", "session_date", F.col("observed_at").alias("fill_at"),
            F.col("price").alias("__price"),
        ),
        by=["symbol", "session_date"],
        left_time="__ready",
        right_time="fill_at",
        values=["__price"],
        direction="forward",
        segmentation=segmentation,
    )
    price = F.col("__price").cast("double")
    return found.withColumn(
        "fill_price",
        F.when(F.col("side") == "buy", adjusted_buy(price, profile)).when(
            F.col("side") == "sell", adjusted_sell(price, profile)
        ),
    ).drop("__ready", "__price")


def outcome_return(prefix: str = "") -> Column:
    """Return of an outcome row when it is known, null otherwise."""

    def col(name: str) -> Column:
        return F.col(f"{prefix}{name}")

    value = col("shadow_return")
    known = (
        (col("status") == "complete")
        & col("fidelity").isin(*KNOWN_FIDELITIES)
        & (col("outcome") != AMBIGUOUS)
    )
    return F.when(
        known & (col("entry_triggered") == F.lit(False)) & (col("outcome") == NO_TRIGGER),
        F.lit(0.0),
    ).when(
        known
        & (col("entry_triggered") == F.lit(True))
        & col("outcome").isin(TARGET_FIRST, STOP_FIRST, END_OF_DAY)
        & ~F.isnan(value)
        & (F.abs(value) != F.lit(float("inf"))),
        value,
    )


def market_enabled(market: Column, *validated: Column) -> Column:
    """US is always on; CA needs every validation flag."""
    name = F.upper(market)
    everything = F.lit(True)
    for flag in validated:
        everything = everything & F.coalesce(flag, F.lit(False))
    return (name == "US") | ((name == "CA") & everything)

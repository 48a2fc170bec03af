"""Trades and reports as append-only tables: cash, positions, planned against observed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import KeyedSeries, Segmentation

# Fixed values ------------------------------------------------------------------------
CASH_TOLERANCE = 1e-9
STARTING_CASH = 100.0
# -------------------------------------------------------------------------------------


def ledger_audit(
    fills: DataFrame,
    starting_cash: float = STARTING_CASH,
    *,
    account: str = "account",
    order_tie: Sequence[str] = (),
    segmentation: Segmentation | None = None,
) -> DataFrame:
    """Running cash and position after every fill, with rule violations flagged.

    `fills`: account, filled_at, sequence, side (BUY/SELL), quantity, price, fees. A fill is
    flagged when it opens a second position, costs more than the cash before it, or sells
    more than is held. Long accounts are cut into segments.
    """
    quantity = F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    frame = fills.withColumns(
        {
            "__us": F.unix_micros(F.col("filled_at").cast("timestamp")),
            "__signed": quantity.cast("double"),
            "__flow": -quantity * F.col("price") - F.col("fees"),
        }
    )
    segmentation = segmentation or Segmentation.for_input(frame, [account], F.col("__us"))
    series = KeyedSeries(frame, [account], ["__us", "sequence", *order_tie], segmentation)
    series.accumulate(sums={"__cash": F.col("__flow"), "position": F.col("__signed")})
    before_cash = F.lit(float(starting_cash)) + F.col("__cash") - F.col("__flow")
    before_position = F.col("position") - F.col("__signed")
    buy = F.col("side") == "BUY"
    return (
        series.finish()
        .withColumns(
            {
                "cash": F.lit(float(starting_cash)) + F.col("__cash"),
                "second_position": buy & (before_position > 0),
                "over_cash": buy
                & (F.col("quantity") * F.col("price") > before_cash + CASH_TOLERANCE),
                "unmatched_sell": ~buy & (before_position < F.col("quantity")),
            }
        )
        .drop("__us", "__signed", "__flow", "__cash")
    )


def reconstruct_cash(
    fills: DataFrame, starting_cash: float = STARTING_CASH, by: Sequence[str] = ("account",)
) -> DataFrame:
    signed = F.when(F.col("side") == "BUY", F.lit(-1.0)).otherwise(F.lit(1.0))
    flow = signed * F.col("quantity") * F.col("price") - F.col("fees")
    return fills.groupBy(*by).agg((F.lit(float(starting_cash)) + F.sum(flow)).alias("cash"))


def available_cash(
    outcomes: DataFrame, starting_cash: float, by: Sequence[str] = ("account",)
) -> DataFrame:
    """Starting cash plus realized results; open trades (null) are skipped."""
    cash = F.lit(float(starting_cash)) + F.coalesce(F.sum("realized_pnl"), F.lit(0.0))
    return outcomes.groupBy(*by).agg(cash.alias("cash"), (cash > 0).alias("usable"))


def one_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by `order`, ties by all other columns (nulls first).

    One map-side combined aggregation, so a key that many rows repeat is no hot group.
    """
    first = [*order, *[name for name in df.columns if name not in (*key, *order)]]
    return df.groupBy(*key).agg(F.min(F.struct(*first)).alias("__r")).select(
        *key, *[F.col("__r").getField(name).alias(name) for name in df.columns if name not in key]
    )


def planned_vs_actual(
    plans: DataFrame, trades: DataFrame, *, order: Sequence[str] = (), extra: Sequence[str] = ()
) -> DataFrame:
    """Primary plan next to the manual trade of the same snapshot.

    A snapshot and symbol have one plan and one trade. Where a side repeats them, its first row
    by `order` counts, ties by its other columns. `extra` columns of the trade are passed on.
    """
    key = ["snapshot_id", "symbol"]
    entry, leave, quantity = F.col("entry_price"), F.col("exit_price"), F.col("quantity")
    kept = [name for name in ("entry_price", "exit_price", "quantity", "exit_reason", *extra, *order) if name in trades.columns]
    plan = one_per_key(plans, key, [name for name in order if name in plans.columns])
    made = one_per_key(trades.select(*key, *dict.fromkeys(kept)), key, [name for name in order if name in trades.columns])
    planned = [name for name in plan.columns if name.startswith("planned_")]
    return plan.select(*key, *planned).join(made, key).select(
        *key,
        "planned_entry",
        "planned_stop",
        "planned_target",
        "planned_quantity",
        entry.alias("actual_entry"),
        leave.alias("actual_exit"),
        quantity.alias("actual_quantity"),
        ((leave - entry) * quantity).alias("realized_pnl"),
        "exit_reason",
        *extra,
    )


def open_positions(
    trades: DataFrame, events: DataFrame, by: Sequence[str] = ("account",)
) -> DataFrame:
    """Accounts with an open manual trade, or whose last legacy event is an entry."""
    open_trades = trades.groupBy(*by).agg(F.count_if(F.col("exit_price").isNull()).alias("__open"))
    last = events.groupBy(*by).agg(F.max_by("kind", "event_order").alias("__kind"))
    return (
        open_trades.join(last, list(by), "full_outer")
        .select(
            *by,
            (
                (F.coalesce("__open", F.lit(0)) > 0)
                | (F.coalesce("__kind", F.lit("")) == "entry")
            ).alias("has_open_position"),
        )
    )


def first_report(reports: DataFrame) -> DataFrame:
    """One report per session: the first saved stays."""
    rest = [name for name in reports.columns if name != "session"]
    return reports.groupBy("session").agg(
        F.min_by(F.struct(*rest), F.struct("created_at", "report_order")).alias("__r")
    ).select("session", "__r.*")


def latest_report(reports: DataFrame) -> DataFrame:
    """Newest by instant, then by insertion (a top-1 that stays distributed)."""
    return reports.orderBy(F.col("created_at").desc(), F.col("report_order").desc()).limit(1)


def history(rows: DataFrame, at: str, tie_break: str, limit: int | None = None) -> DataFrame:
    """Newest first; a limit makes it a distributed top-k."""
    ordered = rows.orderBy(F.col(at).desc(), F.col(tie_break).desc())
    return ordered if limit is None else ordered.limit(limit)


def mask_stale(reports: DataFrame, today: Column) -> DataFrame:
    """A report of another session shows as STALE without a primary."""
    stale = F.col("session") != today
    return reports.withColumns(
        {
            "decision": F.when(stale, "NO TRADE").otherwise(F.col("decision")),
            "state": F.when(stale, "STALE").otherwise(F.col("state")),
            "primary_symbol": F.when(~stale, F.col("primary_symbol")),
        }
    )


def incomplete_reports(reports: DataFrame, outcomes: DataFrame, rows: int = 30) -> DataFrame:
    """Reports with fewer outcomes than cohort rows."""
    counts = outcomes.groupBy("snapshot_id").agg(F.count("*").alias("__n"))
    return (
        reports.join(counts, "snapshot_id", "left")
        .withColumn("outcomes", F.coalesce("__n", F.lit(0)))
        .filter(F.col("outcomes") < rows)
        .drop("__n")
    )


def with_report_metadata(rows: DataFrame, reports: DataFrame, names: Sequence[str]) -> DataFrame:
    """Attach report fields to decision rows; a row's own value wins."""
    renamed = reports.select("snapshot_id", *[F.col(n).alias(f"__m_{n}") for n in names])
    joined = rows.join(renamed, "snapshot_id", "left")
    values = {
        name: F.coalesce(F.col(name), F.col(f"__m_{name}"))
        if name in rows.columns
        else F.col(f"__m_{name}")
        for name in names
    }
    return joined.withColumns(values).drop(*[f"__m_{n}" for n in names])


def observed_status(threshold: Column, low: Column, high: Column, *, above: bool) -> Column:
    reached = (high >= threshold) if above else (low <= threshold)
    return (
        F.when(threshold.isNull() | low.isNull(), "unavailable")
        .when(reached, "observed")
        .otherwise("not_observed")
    )


def daily_evaluation(
    cohort: DataFrame, quotes: DataFrame, outcomes: DataFrame, missed: DataFrame, trades: DataFrame
) -> DataFrame:
    """Cohort rows against the quotes seen after the decision.

    `cohort`: snapshot_id, symbol, session_date, decided_at, entry, stop, target, primary,
    finalist. Quotes are reduced to one row per cohort row before anything else is joined.
    """
    at, price = F.col("received_at"), F.col("last_trade_price")
    usable = price > 0
    seen = (
        cohort.select("snapshot_id", "symbol", "session_date", "decided_at")
        .join(
            quotes.select("symbol", "session_date", "received_at", "last_trade_price"),
            ["symbol", "session_date"],
        )
        .filter(at >= F.col("decided_at"))
        .groupBy("snapshot_id", "symbol")
        .agg(
            F.min(F.when(usable, price)).alias("observed_min_price"),
            F.max(F.when(usable, price)).alias("observed_max_price"),
            F.max_by(price, F.when(usable, at)).alias("latest_price"),
            F.count("*").alias("observation_count"),
            F.min(at).alias("observed_from"),
            F.max(at).alias("observed_to"),
        )
    )
    low, high = F.col("observed_min_price"), F.col("observed_max_price")
    key = ["snapshot_id", "symbol"]
    flags = lambda frame, name: (
        frame.select(*key).distinct().withColumn(name, F.lit(True))
    )
    primary = F.coalesce(F.col("primary"), F.lit(False))
    return (
        cohort.join(seen, key, "left")
        .join(outcomes.select(*key, F.col("outcome").alias("shadow_outcome")), key, "left")
        .join(flags(missed, "__missed"), key, "left")
        .join(flags(trades, "__traded"), key, "left")
        .withColumns(
            {
                "role": F.when(primary, "PRIMARY")
                .when(F.coalesce(F.col("finalist"), F.lit(False)), "FINALIST")
                .otherwise("COHORT"),
                "observation_count": F.coalesce("observation_count", F.lit(0)),
                "entry_status": observed_status(F.col("entry"), low, high, above=True),
                "stop_status": observed_status(F.col("stop"), low, high, above=False),
                "target_status": observed_status(F.col("target"), low, high, above=True),
                "missed_primary": F.col("__missed").isNotNull() & primary,
                "manual_trade_executed": F.col("__traded").isNotNull(),
            }
        )
        .drop("__missed", "__traded")
    )

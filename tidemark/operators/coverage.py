"""Audit of stored bars against the minutes a schedule expects.

`schedule` holds one row per session: session_date, open_at, close_at (UTC instants).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import POST_MARKET, PRE_MARKET, REGULAR, is_session, session_phase
from tidemark.operators.segments import KeyedSeries, Segmentation

# Fixed values ------------------------------------------------------------------------
COVERED = ("complete", "accepted_gap", "accepted_sparse")
MAX_ACCEPTED_GAP = 5
NO_BARS = "provider returned no candles"
DUPLICATES = "provider returned duplicate minute candles"
DISORDER = "one-minute candles are out of order"
SPARSE_REASON = "no bar-eligible trades in missing minute(s)"
GAP_REASON = "provider missing minute"
# -------------------------------------------------------------------------------------

KEY = ["symbol", "session_date"]


def _step(minutes: int) -> Column:
    return F.expr(f"INTERVAL {int(minutes)} MINUTES")


def _expected(minutes: int) -> Column:
    """Grid of a session as an array; bounded by the minutes of one day."""
    return F.sequence(F.col("open_at"), F.col("close_at") - _step(minutes), _step(minutes))


def expected_minutes(keys: DataFrame, schedule: DataFrame, minutes: int = 1) -> DataFrame:
    """One row per expected bar start of every (symbol, session)."""
    return keys.join(schedule, "session_date").select(
        *KEY, F.explode(_expected(minutes)).alias("start")
    )


def missing_minutes(
    bars: DataFrame, keys: DataFrame, schedule: DataFrame, minutes: int = 1
) -> DataFrame:
    """Expected bar starts without a bar."""
    return expected_minutes(keys, schedule, minutes).join(
        bars.select(*KEY, "start").distinct(), [*KEY, "start"], "left_anti"
    )


def trim_close_bar(bars: DataFrame, schedule: DataFrame, minutes: int = 1) -> DataFrame:
    """Drop the bar an inclusive end time returned exactly at the close."""
    joined = bars.join(schedule.select("session_date", "close_at"), "session_date", "left")
    at_close = (F.col("start") == F.col("close_at")) & (
        F.col("end") == F.col("close_at") + _step(minutes)
    )
    return joined.filter(~F.coalesce(at_close, F.lit(False))).drop("close_at")


def phase_rows(bars: DataFrame, minutes: int = 1) -> DataFrame:
    """Bars per phase, plus rows of the wrong length or outside every phase."""
    phase = session_phase(F.col("start"))
    length = F.unix_micros("end") - F.unix_micros("start") == minutes * 60_000_000
    return (
        bars.withColumns({"__phase": phase, "__length": length})
        .groupBy(*KEY)
        .agg(
            F.count_if(F.col("__phase") == PRE_MARKET).alias("pre_market_rows"),
            F.count_if(F.col("__phase") == REGULAR).alias("regular_rows"),
            F.count_if(F.col("__phase") == POST_MARKET).alias("post_market_rows"),
            F.count_if(F.col("__phase").isNull()).alias("outside_rows"),
            F.count_if(~F.col("__length")).alias("wrong_length_rows"),
        )
    )


def coverage_status(
    bars: DataFrame,
    keys: DataFrame,
    schedule: DataFrame,
    minutes: int = 1,
    *,
    ordinal: str | None = None,
) -> DataFrame:
    """Status, reason and missing starts of every expected (symbol, session).

    Rules are tried in a fixed order: duplicates, disorder (needs the ingest `ordinal`),
    nothing stored, too many rows, a row off the grid, missing minutes. Duplicates and
    disorder look at all stored rows, the others at rows inside [open, close).
    """
    frame = bars
    if ordinal is not None:
        # The ordinal counts rows, so its cell is one.
        cut = Segmentation.for_input(bars, KEY, F.col(ordinal), cell=1)
        series = KeyedSeries(bars, KEY, [ordinal], cut, halo=1)
        series.with_columns({"__back": F.lag("start").over(series.local) > F.col("start")})
        frame = series.finish()
    else:
        frame = bars.withColumn("__back", F.lit(False))
    scheduled = frame.join(schedule, "session_date", "inner")
    inside = (F.col("start") >= F.col("open_at")) & (F.col("start") < F.col("close_at"))
    micros = F.unix_micros
    width = minutes * 60_000_000
    on_grid = (F.pmod(micros("start") - micros("open_at"), F.lit(width)) == 0) & (
        micros("end") - micros("start") == width
    )
    # Combine equal starts first: duplicates of one start never travel as separate rows.
    per_start = (
        scheduled.withColumns({"__in": inside, "__grid": on_grid})
        .groupBy(*KEY, "start")
        .agg(
            F.count("*").alias("__n"),
            F.bool_or("__back").alias("__back"),
            F.bool_or("__in").alias("__in"),
            F.bool_and("__grid").alias("__grid"),
        )
    )
    bad = F.col("__in") & ~F.col("__grid")
    per_key = per_start.groupBy(*KEY).agg(
        F.max("__n").alias("__repeats"),
        F.bool_or("__back").alias("__back"),
        F.sum(F.when(F.col("__in"), F.col("__n")).otherwise(0)).alias("rows"),
        F.min(F.when(bad, F.col("start"))).alias("__bad_at"),
        F.collect_set(F.when(F.col("__in") & F.col("__grid"), F.col("start"))).alias("__seen"),
    )
    before_bad = (
        per_start.join(
            per_key.filter(F.col("__bad_at").isNotNull()).select(*KEY, "__bad_at"), KEY
        )
        .filter(F.col("__in") & (F.col("start") < F.col("__bad_at")))
        .groupBy(*KEY)
        .agg(F.count("*").alias("__bad_row"))
    )
    wanted = keys.join(schedule, "session_date").withColumn("__grid", _expected(minutes))
    joined = (
        wanted.join(per_key, KEY, "left")
        .join(before_bad, KEY, "left")
        .withColumns(
            {
                "rows": F.coalesce("rows", F.lit(0)),
                "expected_rows": F.size("__grid"),
                "missing": F.array_except(
                    "__grid", F.coalesce("__seen", F.array().cast("array<timestamp>"))
                ),
            }
        )
    )
    missing = F.size("missing")
    off_grid = F.col("__bad_at").isNotNull()
    duplicate = F.coalesce(F.col("__repeats") > 1, F.lit(False))
    disorder = F.coalesce(F.col("__back"), F.lit(False))
    empty = F.col("rows") == 0
    too_many = F.col("rows") > F.col("expected_rows")
    reason = (
        F.when(duplicate, DUPLICATES)
        .when(disorder, DISORDER)
        .when(empty, NO_BARS)
        .when(
            too_many,
            F.concat(
                F.lit("expected "),
                F.col("expected_rows").cast("string"),
                F.lit(" one-minute candles, received "),
                F.col("rows").cast("string"),
            ),
        )
        .when(
            off_grid,
            F.concat(
                F.lit("one-minute coverage gap or wrong range at row "),
                F.coalesce("__bad_row", F.lit(0)).cast("string"),
            ),
        )
        .when(
            missing > 0,
            F.concat(F.lit("provider missing "), missing.cast("string"), F.lit(" minute(s)")),
        )
    )
    early = duplicate | disorder | empty | too_many | off_grid
    return joined.withColumns(
        {
            "reason": reason,
            "status": F.when(reason.isNull(), "complete")
            .when(~duplicate & ~disorder & empty, "missing")
            .otherwise("incomplete"),
        }
    ).select(
        *KEY,
        "rows",
        "expected_rows",
        "status",
        "reason",
        F.when(early, F.array().cast("array<timestamp>"))
        .otherwise(F.col("missing"))
        .alias("missing"),
    )


def accept_gaps(
    first: DataFrame, second: DataFrame, trades: DataFrame | None = None, minutes: int = 1,
    *, of_others: bool = False,
) -> DataFrame:
    """Accept a gap that two observations agree on.

    With a trades table (symbol, traded_at, creates_bar) the gap is `accepted_sparse` only if
    no bar-eligible trade falls into a missing minute, of its own symbol or, with `of_others`, of
    any other one. Without one it is `accepted_gap` when at most five minutes are missing.
    """
    both = first.select(*KEY, "status", "reason", "missing").join(
        second.select(
            *KEY, F.col("status").alias("__status2"), F.col("missing").alias("__missing2")
        ),
        KEY,
    )
    agreed = (F.size("missing") > 0) & (F.col("missing") == F.col("__missing2"))
    open_status = F.col("status").isin("missing", "incomplete") & F.col("__status2").isin(
        "missing", "incomplete"
    )
    if trades is None:
        accepted = agreed & open_status & (F.size("missing") <= MAX_ACCEPTED_GAP)
        label, why = "accepted_gap", GAP_REASON
        frame = both
    else:
        width = minutes * 60_000_000
        start = F.timestamp_micros((F.floor(F.unix_micros("traded_at") / width) * width).cast("long"))
        made = trades.filter("creates_bar").select("symbol", start.alias("start"))
        gaps = both.filter(agreed).select(*KEY, F.explode("missing").alias("start"))
        if of_others:
            # The first and the last symbol of a minute tell whether another one traded in it.
            busy = made.groupBy("start").agg(F.min("symbol").alias("__low"), F.max("symbol").alias("__high"))
            met = gaps.join(busy, "start").filter((F.col("__low") != F.col("symbol")) | (F.col("__high") != F.col("symbol")))
        else:
            met = gaps.join(made, ["symbol", "start"], "left_semi")
        contradicted = met.select(*KEY).distinct().withColumn("__traded", F.lit(True))
        frame = both.join(contradicted, KEY, "left")
        accepted = agreed & F.col("__traded").isNull()
        label, why = "accepted_sparse", SPARSE_REASON
    return frame.select(
        *KEY,
        F.when(accepted, F.lit(label)).otherwise(F.col("status")).alias("status"),
        F.when(accepted, F.lit(why)).otherwise(F.col("reason")).alias("reason"),
        F.size("missing").alias("missing_minutes"),
    )


def required_keys(expected: DataFrame) -> DataFrame:
    """Every trading session between the first and last expected date, for every symbol."""
    span = expected.agg(F.min("session_date").alias("a"), F.max("session_date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("session_date")).filter(
        is_session(F.col("session_date"))
    )
    # One array of at most a few hundred dates a year, attached to each distinct symbol.
    dates = days.agg(F.collect_set("session_date")).scalar()
    return (
        expected.select("symbol")
        .distinct()
        .withColumn("__dates", dates)
        .select("symbol", F.explode("__dates").alias("session_date"))
    )


def trading_keys(expected: DataFrame) -> DataFrame:
    """Expected keys without dates on which the market was closed."""
    return expected.filter(is_session(F.col("session_date")))


def coverage_summary(
    entries: DataFrame, expected: DataFrame, *, months: tuple[int, int] = (12, 24)
) -> DataFrame:
    """One-row summary: counts by status, span, completeness, continuity, history targets."""
    status = F.col("status")
    covered = status.isin(*COVERED)
    joined = expected.select(*KEY).distinct().join(entries.select(*KEY, "status"), KEY, "left")
    request = joined.agg(
        F.count("*").alias("expected"),
        F.min(F.when(covered, F.col("session_date"))).alias("first_covered"),
        F.max(F.when(covered, F.col("session_date"))).alias("last_covered"),
        F.bool_and(F.coalesce(status == "complete", F.lit(False))).alias("all_complete"),
        F.bool_and(F.coalesce(covered, F.lit(False))).alias("all_covered"),
        F.min("session_date").alias("__from"),
        F.max("session_date").alias("__to"),
        F.lit(1).alias("__one"),
    ).withColumn("__one", F.lit(1))
    totals = entries.agg(
        *[
            F.count_if(status == name).alias(name)
            for name in ("complete", "accepted_gap", "accepted_sparse", "incomplete", "missing")
        ]
    ).withColumn("__one", F.lit(1))
    wanted, have = required_keys(expected), expected.select("symbol", "session_date").distinct()
    gaps = (
        wanted.join(have, ["symbol", "session_date"], "left_anti")
        .unionByName(have.join(wanted, ["symbol", "session_date"], "left_anti"))
        .agg((F.count("*") == 0).alias("continuous"))
        .withColumn("__one", F.lit(1))
    )
    # Three one-row aggregates joined on a constant.
    out = request.join(totals, "__one").join(gaps, "__one")
    target = F.col("continuous") & F.col("all_covered")
    return out.withColumns(
        {
            "span_days": F.coalesce(F.datediff("last_covered", "first_covered"), F.lit(0)),
            "meets_minimum_history": target
            & (F.col("__to") >= F.add_months("__from", months[0])),
            "meets_preferred_history": target
            & (F.col("__to") >= F.add_months("__from", months[1])),
        }
    ).drop("__one", "__from", "__to")


def audit_exit_code(entries: DataFrame) -> DataFrame:
    """2 when anything failed, 3 when anything is not covered, else 0."""
    status = F.col("status")
    return entries.agg(
        F.when(F.count_if(status == "failed") > 0, 2)
        .when(F.count_if(~status.isin(*COVERED)) > 0, 3)
        .otherwise(0)
        .alias("exit_code")
    )

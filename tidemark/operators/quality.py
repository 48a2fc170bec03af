"""Quote quality, freshness, latest-state and symbol-hygiene operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import REGULAR, exchange_date, is_session, session_phase

# Fixed values ------------------------------------------------------------------------
VERDICTS = (
    "DELAYED_QUOTE",
    "HALTED",
    "SOURCE_TIME_UNVERIFIED",
    "STALE_QUOTE",
    "INCOMPLETE_LEVEL1",
    "INVALID_PRICE",
    "CROSSED_MARKET",
)
VERIFIED_ORIGIN = "http_date"
MAX_LATENCY_MS = 5_000
MAX_QUOTE_AGE_SECONDS = 300
RETENTION_DAYS = 30
BAR_EXCLUDING_CONDITIONS = (
    "C", "G", "H", "I", "M", "N", "P", "Q", "R", "U", "V", "W", "Z", "4", "7", "9",
)
KNOWN_CONDITIONS = (
    " ", "@", "A", "B", "C", "D", "E", "F", "G", "H", "I", "K", "L", "M", "N", "O", "P", "Q",
    "R", "T", "U", "V", "W", "X", "Y", "Z", "4", "5", "6", "7", "9",
)
# -------------------------------------------------------------------------------------


def quote_verdict(max_latency_ms: int = MAX_LATENCY_MS) -> Column:
    """First failed quality rule of a level-1 quote, null when it may be traded on."""
    bid, ask, last = F.col("bid_price"), F.col("ask_price"), F.col("last_trade_price")
    delayed, halted, unverified, stale, incomplete, invalid, crossed = VERDICTS
    return (
        F.when(F.col("delay_seconds") != 0, delayed)
        .when(F.col("is_halted"), halted)
        .when(F.col("source_time_origin") != VERIFIED_ORIGIN, unverified)
        .when(F.col("latency_ms") > max_latency_ms, stale)
        .when(bid.isNull() | ask.isNull() | last.isNull(), incomplete)
        .when(F.least(bid, ask, last) <= 0, invalid)
        .when(ask < bid, crossed)
    )


def classify_quotes(quotes: DataFrame, max_latency_ms: int = MAX_LATENCY_MS) -> DataFrame:
    """Add verdict, eligibility, exchange session date and phase (from the trade time when
    known, else the source time)."""
    market_at = (
        F.coalesce(F.col("last_trade_time"), F.col("source_at"))
        if "last_trade_time" in quotes.columns
        else F.col("source_at")
    )
    return quotes.withColumns(
        {
            "invalid_reason": quote_verdict(max_latency_ms),
            "session_phase": session_phase(market_at),
            "session_date": exchange_date(market_at),
        }
    ).withColumn("is_trade_eligible", F.col("invalid_reason").isNull())


def regular_eligible(quotes: DataFrame) -> DataFrame:
    """Eligible quotes received during the regular hours of a session (early closes respected)."""
    return quotes.filter(F.col("is_trade_eligible") & in_regular_session(F.col("received_at")))


def in_regular_session(at: Column) -> Column:
    """Regular hours of a trading date; weekends and holidays have none."""
    return (session_phase(at) == REGULAR) & is_session(exchange_date(at))


def latest_quotes(quotes: DataFrame, tie_break: str = "event_id") -> DataFrame:
    """Latest row per symbol; combines on the map side, so one row per symbol and task moves."""
    columns = [name for name in quotes.columns if name != "symbol"]
    newest = F.max_by(F.struct(*columns), F.struct("received_at", tie_break)).alias("__row")
    return quotes.groupBy("symbol").agg(newest).select("symbol", "__row.*")


def session_quotes(quotes: DataFrame, symbol: str, session: Column) -> DataFrame:
    """One symbol's session in time order (a filtered scan, then a sort of that slice)."""
    return quotes.filter(
        (F.col("symbol") == symbol.strip().upper()) & (F.col("session_date") == session)
    ).orderBy("received_at")


def keep_since(quotes: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows the retention rule keeps; on a date-partitioned table this prunes directories."""
    return quotes.filter(F.col("received_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS"))


def freshness_reason(
    received_at: Column, decided_at: Column, not_before: Column | None = None
) -> Column:
    """Why an observation may not support a decision at `decided_at`, null when it may."""
    age = (F.unix_micros(decided_at) - F.unix_micros(received_at)) / F.lit(1_000_000)
    rule = F.when(
        exchange_date(received_at) != exchange_date(decided_at), "another session"
    ).when(age < 0, "received after decision")
    rule = rule.when(age > MAX_QUOTE_AGE_SECONDS, "stale quote")
    if not_before is not None:
        rule = rule.when(decided_at < not_before, "before decision time")
    return rule


def group_return(
    quotes: DataFrame,
    cutoff: Column,
    *,
    by: Sequence[str] = (),
    strict: bool = True,
) -> DataFrame:
    """Mean last/first - 1 of a set of symbols per session up to a cutoff.

    A member counts when it has two or more eligible regular-session rows and its latest
    row is at most five minutes old. `strict` (market benchmarks) gives null unless every
    member counts; otherwise (sector peers) members that do not count are left out.
    `members` is how many the set has, `used` how many counted.
    """
    at, price = F.col("received_at"), F.col("last_trade_price").cast("double")
    regular = F.col("is_trade_eligible") & in_regular_session(at)
    per_member = (
        quotes.withColumns({"__cutoff": cutoff, "__ok": regular})
        .filter(at <= F.col("__cutoff"))
        .groupBy(*by, "session_date", "symbol")
        .agg(
            F.count_if("__ok").alias("__rows"),
            F.min_by(F.when(F.col("__ok"), price), F.when(F.col("__ok"), at)).alias("__first"),
            F.max_by(F.when(F.col("__ok"), price), F.when(F.col("__ok"), at)).alias("__last"),
            F.max_by("is_trade_eligible", at).alias("__eligible"),
            F.max(at).alias("__at"),
            F.max("__cutoff").alias("__cutoff"),
        )
    )
    age = (F.unix_micros("__cutoff") - F.unix_micros("__at")) / F.lit(1_000_000)
    usable = (
        (F.col("__rows") >= 2)
        & F.col("__eligible")
        & age.between(0, MAX_QUOTE_AGE_SECONDS)
        & (F.col("__first") > 0)
        & (F.col("__last") > 0)
    )
    value = F.when(usable, F.col("__last") / F.col("__first") - 1)
    out = per_member.groupBy(*by, "session_date").agg(
        F.count("*").alias("members"), F.count(value).alias("used"), F.avg(value).alias("mean")
    )
    keep = (F.col("used") == F.col("members")) if strict else (F.col("used") > 0)
    return out.withColumn("group_return", F.when(keep, F.col("mean"))).drop("mean")


def can_create_bar(conditions: Column, tape: Column, size: Column) -> Column:
    """Could this trade print create a minute bar? Unknown conditions count as yes."""
    known = F.array(*[F.lit(code) for code in KNOWN_CONDITIONS])
    excluding = F.array(*[F.lit(code) for code in BAR_EXCLUDING_CONDITIONS])
    return (
        F.when(
            conditions.isNull() | F.exists(conditions, lambda code: code.isNull()), F.lit(True)
        )
        .when(F.size(F.array_except(conditions, known)) > 0, F.lit(True))
        .when(F.arrays_overlap(conditions, excluding), F.lit(False))
        .when(
            F.array_contains(conditions, "B") & F.coalesce(tape.isin("A", "B"), F.lit(False)),
            F.lit(False),
        )
        .otherwise(F.coalesce(size > 0, F.lit(True)))
    )


def normalize_symbol(symbol: Column) -> Column:
    return F.upper(F.trim(symbol))


def symbol_problems(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """Blank, non-ticker and repeated symbols with their row counts; empty means clean."""
    name = normalize_symbol(F.col(column))
    return (
        symbols.groupBy(name.alias("symbol"))
        .agg(F.count("*").alias("rows"))
        .withColumn(
            "problem",
            F.when(F.col("symbol") == "", "blank symbol")
            .when(F.contains("symbol", F.lit("=")), "not a bare ticker")
            .when(F.col("rows") > 1, "duplicate symbol"),
        )
        .filter(F.col("problem").isNotNull())
    )


def distinct_symbols(symbols: DataFrame, column: str = "symbol") -> DataFrame:
    """Normalised, non-blank symbols, each once."""
    name = normalize_symbol(F.col(column))
    return symbols.select(name.alias("symbol")).filter(F.col("symbol") != "").distinct()


def safe_partition_value(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9._-]+$")


def lacks(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested keys that were not returned (unresolved symbols, missing quotes)."""
    return left.join(right.select(*keys).distinct(), list(keys), "left_anti")


def resolve_symbols(requested: DataFrame, hits: DataFrame) -> DataFrame:
    """First tradable, quotable exact match per requested symbol; null id when unresolved.

    `hits` has symbol, symbol_id, is_quotable, is_tradable and position (order of return).
    """
    found = (
        hits.filter("is_quotable AND is_tradable")
        .groupBy(normalize_symbol(F.col("symbol")).alias("symbol"))
        .agg(F.min_by("symbol_id", "position").alias("symbol_id"))
    )
    return distinct_symbols(requested).join(found, "symbol", "left")

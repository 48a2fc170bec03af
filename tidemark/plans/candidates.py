"""From raw quotes to decision candidates: features, completeness, returns, evidence, identity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import is_finite
from tidemark.functions.scores import blended_market_score, market_score
from tidemark.operators.features import KEYS, market_features, one_per_time, opening_range_check, prepare_observations
from tidemark.operators.quality import regular_eligible
from tidemark.plans.decision import UNKNOWN_SECTOR

NO_SAMPLES, OPENING_GAP, FEATURES_MISSING = (
    "candidate:no_samples",
    "candidate:opening_gap",
    "candidate:features_missing",
)
#: A decision needs all of these as finite numbers.
REQUIRED = (
    "last_trade_price", "volume", "rvol", "vwap", "opening_range_high", "opening_range_low",
    "volatility",
)
_SHOWN = (*REQUIRED, "bid_price", "ask_price", "spread_pct", "received_at")


def candidate_rows(
    quotes: DataFrame,
    benchmark_returns: DataFrame,
    identity: DataFrame,
    *,
    as_of: Column | None = None,
) -> DataFrame:
    """One row per (symbol, session) of `quotes` with its evidence or the reason against it.

    `benchmark_returns(session_date, benchmark_return)` and `identity(symbol, sector)` have a row
    per key. Rules are tried in this order: no eligible sample of the regular session, a minute
    of the opening range without a sample, a required feature that is not finite. Rejected rows
    keep null evidence; sector peers are the rows that passed, without unknown sectors.
    """
    known = quotes if as_of is None else quotes.filter(F.col("received_at") <= as_of)
    samples = regular_eligible(known)
    features = market_features(one_per_time(prepare_observations(samples, as_of)), as_of=as_of)
    last = (
        features.groupBy(*KEYS)
        .agg(
            F.max_by(F.struct(*_SHOWN), "received_at").alias("last"),
            F.min_by(F.col("last_trade_price").cast("double"), F.col("received_at")).alias("first_price"),
        )
        .join(opening_range_check(samples).select(*KEYS, "covered"), KEYS, "left")
    )
    complete = reduce(and_, [is_finite(F.col(f"last.{name}")) for name in REQUIRED])
    every = known.select(*KEYS).distinct().join(last, KEYS, "left")
    judged = every.withColumn(
        "reason",
        F.when(F.col("last").isNull(), NO_SAMPLES)
        .when(~F.coalesce("covered", F.lit(False)), OPENING_GAP)
        .when(~complete, FEATURES_MISSING),
    )
    own = F.when(
        F.col("reason").isNull(), F.col("last.last_trade_price").cast("double") / F.col("first_price") - 1
    )
    placed = (
        judged.withColumn("own_return", own)
        .join(identity.select("symbol", "sector"), "symbol", "left")
        .join(benchmark_returns, "session_date", "left")
    )
    grouped = placed.withColumn("sector", F.coalesce("sector", F.lit(UNKNOWN_SECTOR)))
    # Peers are those of the same session.
    peer_key = F.concat_ws("|", "sector", F.col("session_date").cast("string"))
    peers = (
        grouped.filter(F.col("own_return").isNotNull() & (F.upper(F.trim("sector")) != UNKNOWN_SECTOR))
        .groupBy(peer_key.alias("__peers"))
        .agg(F.avg("own_return").alias("sector_return"))
    )
    scored = grouped.withColumn("__peers", peer_key).join(peers, "__peers", "left").drop("__peers")
    evidence = F.struct(
        *[F.col(f"last.{name}").alias(name) for name in _SHOWN],
        F.col("own_return").alias("candidate_return"),
        "benchmark_return",
        market_score(F.col("own_return"), F.col("benchmark_return")).alias("benchmark_score"),
        "sector_return",
        market_score(F.col("own_return"), F.col("sector_return")).alias("sector_score"),
        blended_market_score(
            F.col("own_return"), F.col("benchmark_return"), F.col("sector_return")
        ).alias("market_score"),
    )
    return scored.select(
        *KEYS, "sector", "reason", F.when(F.col("reason").isNull(), evidence).alias("evidence")
    )


def watchlist_quotes(latest: DataFrame, symbols: DataFrame) -> DataFrame:
    """Latest quotes of `symbols(position, symbol)`, each with its place in the caller's list.

    Symbols without a quote are left out; a repeated one appears at each of its places.
    """
    wanted = symbols.select("position", F.upper(F.trim("symbol")).alias("__symbol"))
    return latest.join(wanted, F.upper("symbol") == F.col("__symbol")).drop("__symbol")


def with_identity(
    cohort: DataFrame,
    identity: DataFrame,
    broad_scan: DataFrame,
    extended: DataFrame | None = None,
    by: Sequence[str] = ("session", "symbol"),
) -> DataFrame:
    """The cohort with identity, broad-scan and, where given, extended-hours evidence."""
    out = cohort.join(identity, "symbol", "left").join(broad_scan, list(by), "left")
    return out if extended is None else out.join(extended, list(by), "left")


def unknown_symbols(cohort: DataFrame, identity: DataFrame) -> DataFrame:
    """Cohort rows whose symbol the universe does not have; a run with any must not decide."""
    return cohort.join(identity.select("symbol"), "symbol", "left_anti")

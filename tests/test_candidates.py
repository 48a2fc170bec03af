"""Raw quotes to candidates with reasons and evidence."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import candidates

SCHEMA = (
    "symbol string, minute int, last_trade_price double, volume long, bid_price double, ask_price double, "
    "is_trade_eligible boolean"
)


def quotes(spark):
    rows = []
    for symbol, first in (("A", 0), ("B", 0), ("LATE", 3), ("OUT", 0)):
        for minute in range(first, 12):
            price = 10.0 + minute * (0.1 if symbol == "A" else 0.05)
            rows.append((symbol, minute, price, 100 * (minute + 1), price - 0.01, price + 0.01, symbol != "OUT"))
    df = spark.createDataFrame(rows, SCHEMA)
    at = F.timestamp_micros(F.unix_micros(F.lit("2024-01-03 14:30:00").cast("timestamp")) + F.col("minute") * 60_000_000)
    return df.select("*", at.alias("received_at"), F.lit("2024-01-03").cast("date").alias("session_date"))


def test_reasons_and_evidence(spark):
    identity = spark.createDataFrame([("A", "Tech"), ("B", "Tech"), ("LATE", "UNKNOWN")], "symbol string, sector string")
    benchmark = spark.createDataFrame([("2024-01-03", 0.01)], "d string, benchmark_return double").select(
        F.col("d").cast("date").alias("session_date"), "benchmark_return"
    )
    rows = {r.symbol: r for r in candidates.candidate_rows(quotes(spark), benchmark, identity).collect()}
    assert rows["A"].reason is None and rows["B"].reason is None
    assert rows["LATE"].reason == candidates.OPENING_GAP and rows["LATE"].evidence is None
    assert rows["OUT"].reason == candidates.NO_SAMPLES
    a, b = rows["A"].evidence, rows["B"].evidence
    assert a.candidate_return == pytest.approx(11.1 / 10 - 1) and b.candidate_return == pytest.approx(10.55 / 10 - 1)
    assert a.sector_return == pytest.approx((a.candidate_return + b.candidate_return) / 2)
    score = lambda own, other: min(1, max(0, 0.5 + (own - other) / 0.08))
    assert b.market_score == pytest.approx((score(b.candidate_return, 0.01) + score(b.candidate_return, b.sector_return)) / 2)
    # Rows after the cutoff are not seen, and too few rows leave features unfinished.
    early = candidates.candidate_rows(
        quotes(spark), benchmark, identity, as_of=F.lit("2024-01-03 14:33:30").cast("timestamp")
    )
    assert {r.reason for r in early.collect()} <= {candidates.OPENING_GAP, candidates.NO_SAMPLES, candidates.FEATURES_MISSING}


def test_watchlist_keeps_the_callers_order(spark):
    latest = spark.createDataFrame([("AAA", 1.0), ("BBB", 2.0), ("CCC", 3.0)], "symbol string, price double")
    wanted = spark.createDataFrame([(1, " ccc"), (2, "zzz"), (3, "AAA"), (4, "CCC")], "position int, symbol string")
    got = candidates.watchlist_quotes(latest, wanted).orderBy("position").collect()
    assert [(r.position, r.symbol) for r in got] == [(1, "CCC"), (3, "AAA"), (4, "CCC")]


def test_identity_and_unknown_symbols(spark):
    cohort = spark.createDataFrame([("d", "A"), ("d", "X")], "session string, symbol string")
    identity = spark.createDataFrame([("A", "Tech")], "symbol string, sector string")
    scan = spark.createDataFrame([("d", "A", 0.5)], "session string, symbol string, scan double")
    assert [r.symbol for r in candidates.unknown_symbols(cohort, identity).collect()] == ["X"]
    rows = {r.symbol: (r.sector, r.scan) for r in candidates.with_identity(cohort, identity, scan).collect()}
    assert rows == {"A": ("Tech", 0.5), "X": (None, None)}

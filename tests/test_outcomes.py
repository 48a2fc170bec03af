"""First-touch rules against a sequential walk over random paths."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators.outcomes import (
    barrier_outcomes, filled_quantity, manual_fills, market_enabled, plan_problem,
    reference_returns, round_trip_cost, shadow_outcomes,
)
from tidemark.policies import ExecutionProfile

T0 = datetime(2026, 8, 24, 13, 30, tzinfo=timezone.utc)


def walk(entry, stop, target, start, end, bars):
    """The rule as a plain loop."""
    live, best, worst = False, 0.0, 0.0
    for t, high, low, close in bars:
        if t < start:
            continue
        if not live:
            if t > end:
                break
            if high < entry:
                continue
            live = True
            if low <= stop:
                return "ambiguous_same_bar", 0.0, 0.0, None
        best, worst = max(best, high - entry), max(worst, entry - low)
        down, up = low <= stop, high >= target
        if down and up:
            return "ambiguous_same_bar", best, worst, None
        if down:
            return "stop_before_target", best, worst, stop
        if up:
            return "target_before_stop", best, worst, target
    return ("eod", best, worst, bars[-1][3]) if live else ("no_trigger", best, worst, None)


def test_random_paths(spark):
    rng = random.Random(3)
    plans, bars, want = [], [], {}
    for i in range(300):
        price, path = 100.0, []
        for minute in range(25):
            price += rng.choice([-1, -0.5, 0, 0.5, 1])
            low, high = price - rng.choice([0, 0.5, 2]), price + rng.choice([0, 0.5, 2])
            path.append((T0 + timedelta(minutes=minute), high, low, price))
        entry = 100 + rng.choice([-1, 0, 1, 2])
        stop, target = entry - rng.choice([1, 2, 30]), entry + rng.choice([1, 3, 30])
        start, end = T0 + timedelta(minutes=rng.randrange(4)), T0 + timedelta(minutes=18)
        name = f"S{i}"
        plans.append((name, name, T0.date(), entry * 1.0, stop * 1.0, target * 1.0, 2, start, end))
        bars += [(name, T0.date(), t, h, low, c) for t, h, low, c in path]
        want[name] = walk(entry, stop, target, start, end, path)
    p = spark.createDataFrame(
        plans, "snapshot_id string, symbol string, session_date date, entry double, stop double, "
        "target double, quantity int, valid_from timestamp, expires_at timestamp")
    b = spark.createDataFrame(
        bars, "symbol string, session_date date, start timestamp, high double, low double, close double")
    got = {r.symbol: (r.outcome, r.mfe, r.mae, r.exit_price) for r in barrier_outcomes(p, b).collect()}
    assert got == want
    assert len({outcome for outcome, *_ in want.values()}) == 5


def test_shadow_golden_row(spark):
    bars = [(1, 10.2, 9.9, 10.1), (6, 10.8, 10.0, 10.7), (16, 11.2, 10.5, 11.0)]
    b = spark.createDataFrame(
        [("AMD", T0.date(), T0 + timedelta(minutes=m), h, low, c) for m, h, low, c in bars],
        "symbol string, session_date date, start timestamp, high double, low double, close double")
    schema = ("snapshot_id string, symbol string, session_date date, entry double, stop double, "
              "target double, quantity int, valid_from timestamp")
    p = spark.createDataFrame(
        [("s", "AMD", T0.date(), 10.0, 9.5, 11.0, 2, T0), ("s", "NONE", T0.date(), None, None, None, None, T0),
         ("s", "DARK", T0.date(), 10.0, 9.5, 11.0, 2, T0)], schema)
    rows = {r.symbol: r for r in shadow_outcomes(p, b).collect()}
    amd = rows["AMD"]
    assert amd.outcome == "target_before_stop" and amd.time_to_entry_seconds == 60
    assert amd.shadow_return == pytest.approx(0.1) and amd.net_return == pytest.approx(0.1)
    assert rows["NONE"].status == rows["DARK"].status == "unavailable"
    assert rows["NONE"].reason != rows["DARK"].reason
    starts = shadow_outcomes(p, b).filter("symbol = 'AMD'")
    refs = {r.minutes: r.reference_return for r in reference_returns(starts, b).collect()}
    assert refs[5] == pytest.approx(0.07) and refs[60] is None


def test_costs_and_fills(spark):
    profile = ExecutionProfile(commission_per_order=1, slippage_bps=10, manual_latency_seconds=30, fill_ratio=0.5)
    row = spark.range(1).select(
        round_trip_cost(F.lit(10.0), F.lit(11.0), F.lit(2), profile).alias("cost"),
        filled_quantity(F.lit(3), profile).alias("filled"),
        market_enabled(F.lit("us")).alias("us"),
        market_enabled(F.lit("CA"), F.lit(True), F.lit(False)).alias("ca"),
    ).first()
    assert row.cost == pytest.approx((0.01 + 0.011) * 2 + 2)
    assert (row.filled, row.us, row.ca) == (1, True, False)
    signals = spark.createDataFrame(
        [("a", "X", T0.date(), T0, "buy")],
        "signal_id string, symbol string, session_date date, signal_at timestamp, side string")
    seen = spark.createDataFrame(
        [("X", T0.date(), T0 + timedelta(seconds=s), p) for s, p in ((10, 9.0), (30, 10.0), (60, 12.0))],
        "symbol string, session_date date, observed_at timestamp, price double")
    assert manual_fills(signals, seen, profile).first().fill_price == pytest.approx(10.01)


def test_plan_rules(spark):
    df = spark.createDataFrame(
        [(10.0, 9.0, 12.0, 1), (10.0, 10.0, 12.0, 1), (10.0, 9.0, 10.0, 1), (10.0, 9.0, 12.0, 0), (None, 9.0, 12.0, 1)],
        "entry double, stop double, target double, quantity int")
    assert [r.p is None for r in df.select(plan_problem().alias("p")).collect()] == [True, False, False, False, False]
    with pytest.raises(ValueError):
        ExecutionProfile(slippage_bps=10_000)
    with pytest.raises(ValueError):
        ExecutionProfile(fx_fee_bps=1)

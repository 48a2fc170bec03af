"""Hand-computed feature values on a six-row session."""

from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators.bars import (
    bar_problem, compare_bars, order_problems, resample, rollup, with_volume_delta,
)
from tidemark.operators.features import (
    duplicate_observations, market_features, minute_bar_features, observation_problem,
    opening_range_check, prepare_observations,
)
from tidemark.operators.segments import Segmentation

PRICES = [10.0, 10.2, 10.1, 10.4, 10.5, 99.0]
VOLUMES = [100, 150, 190, 250, 320, 9999]
MARKET = [100.0, 100.5, 100.8, 101.0, 101.2, 200.0]


def at(minute):
    return datetime(2026, 8, 24, 13, 30 + minute, tzinfo=timezone.utc)


def samples(spark, prices=PRICES, volumes=VOLUMES, eligible=None):
    eligible = eligible or [True] * len(prices)
    rows = [
        ("AMD", at(i), p, v, p - 0.01, p + 0.01, e)
        for i, (p, v, e) in enumerate(zip(prices, volumes, eligible))
    ]
    return spark.createDataFrame(
        rows,
        "symbol string, received_at timestamp, last_trade_price double, volume long, "
        "bid_price double, ask_price double, is_trade_eligible boolean",
    ).withColumn("session_date", F.to_date("received_at"))


def cutoff(minute):
    return F.lit(at(minute).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


@pytest.mark.parametrize("cut", [None, 1, 2])
def test_golden_features(spark, cut):
    market = samples(spark, MARKET).withColumn("symbol", F.lit("SPY"))
    out = market_features(
        samples(spark), as_of=cutoff(4), previous_close=F.lit(9.5), market=market,
        segmentation=Segmentation(cut),
    ).orderBy("received_at").collect()
    assert len(out) == 5
    assert out[-1].vwap == pytest.approx(10.228125)
    assert out[0].gap_pct == pytest.approx(10 / 9.5 - 1)
    assert out[-1].opening_range_high == 10.5 and out[-1].opening_range_low == 10.0
    assert out[-1].market_relative_strength == pytest.approx(0.038)
    assert out[0].market_relative_strength == 0
    assert out[0].rvol is None and out[0].volatility is None


def test_future_rows_and_input_order_change_nothing(spark):
    base = samples(spark)
    plain = market_features(base.filter(F.col("received_at") <= cutoff(4)), as_of=cutoff(4))
    shuffled = market_features(base.orderBy(F.rand(7)).repartition(5), as_of=cutoff(4))
    names = ["received_at", "vwap", "ema", "rvol", "opening_range_high"]
    assert plain.select(*names).orderBy("received_at").collect() == shuffled.select(
        *names
    ).orderBy("received_at").collect()


def test_ineligible_rows_are_skipped(spark):
    df = samples(spark, [10.0, 99.0, 10.1], [100, 150, 190], [True, False, True])
    out = market_features(df).orderBy("received_at").collect()
    assert len(out) == 2
    assert out[-1].vwap == pytest.approx((10.0 * 100 + 10.1 * 90) / 190)


def test_counter_reset_counts_the_new_value(spark):
    df = samples(spark, [10.0, 10.1, 10.2], [100, 150, 20])
    bar = resample(df, 5).first()
    assert bar.volume == 170 and bar.open == 10.0 and bar.close == 10.2
    deltas = [r.volume_delta for r in with_volume_delta(df).orderBy("received_at").collect()]
    assert deltas == [100, 50, 20]


def test_bars_roll_up_and_compare(spark):
    one = resample(samples(spark), 1)
    five = rollup(one, 5)
    direct = resample(samples(spark), 5)
    assert compare_bars(five, direct).count() == 0
    assert five.orderBy("start").first().volume == 320
    moved = direct.withColumn("close", F.col("close") + 1)
    assert [r.difference for r in compare_bars(five, moved).collect()] == ["close differs"] * 2
    fewer = direct.filter(F.col("start") == at(0))
    assert [r.difference for r in compare_bars(five, fewer).collect()] == ["row count differs"]
    assert one.filter(bar_problem(one).isNotNull()).count() == 0
    assert order_problems(one.unionByName(one)).count() == 1
    assert order_problems(one).count() == 0


def test_minute_bars_have_no_spread(spark):
    bars = resample(samples(spark), 1)
    out = minute_bar_features(bars).collect()
    assert {r.spread_pct for r in out} == {0.0}


def test_expected_volume_replaces_the_trailing_mean(spark):
    df = samples(spark).withColumn("expected_cumulative_volume", F.lit(300.0))
    out = market_features(df, as_of=cutoff(4)).orderBy("received_at").collect()
    assert out[-1].rvol == pytest.approx(320 / 300)


def test_observation_rules(spark):
    df = samples(spark, [10.0, -1.0, 10.1], [100, 150, -5])
    problems = [r.p for r in df.orderBy("received_at").select(observation_problem(df).alias("p")).collect()]
    assert problems == [None, "non-positive price", "negative volume"]
    assert prepare_observations(df).count() == 1
    assert duplicate_observations(df.unionByName(df)).count() == 3


def test_opening_range_needs_every_minute(spark):
    full = opening_range_check(samples(spark)).first()
    assert full.complete and full.covered
    gap = opening_range_check(samples(spark).filter(F.col("received_at") != at(2))).first()
    assert not gap.complete and not gap.covered

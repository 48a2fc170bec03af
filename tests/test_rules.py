"""Rules at their edges: broken numbers, typed payloads, blanks, failing classifiers, sessions."""

import os
import subprocess
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.calendar import is_holiday, trading_calendar
from tidemark.operators import classification, context, quality
from tidemark.operators.features import observation_problem
from tidemark.operators.universe import candidate_problem
from tidemark.plans.decision import sector_peers
from tidemark.policies import CohortPolicy, ExecutionProfile, RankingWeights


def test_numbers_that_are_not_finite_are_broken(spark):
    rows = [(1.0, 1.0, 1.0, 5), (float("nan"), 1.0, 1.0, 5), (1.0, float("inf"), 1.0, 5), (1.0, 1.0, None, 5)]
    df = spark.createDataFrame(rows, "last_trade_price double, bid_price double, ask_price double, volume long")
    df = df.withColumn("received_at", F.lit("2024-01-02").cast("timestamp"))
    assert [r.p is None for r in df.select(observation_problem(df).alias("p")).collect()] == [True, False, False, False]


@pytest.mark.parametrize(
    "payload, want",
    [
        ('{"direction":1,"meta":{"direction":"x"}}', 1.0),
        ('{"direction":null}', 0.0),
        ('{"direction":true}', 1.0),
        ('{"direction":" Negative "}', -1.0),
        ('{"direction":{"a":1}}', 0.0),
        ('{"direction":-7}', -1.0),
        ('{"other":1}', None),
        ("junk", None),
    ],
)
def test_direction_by_type(spark, payload, want):
    df = spark.createDataFrame([(payload,)], "payload string")
    assert df.select(context.direction_of("direction").alias("d")).first().d == want


@pytest.mark.parametrize(
    "payload, want",
    [
        ('{"direction":1,"upvote_ratio":null,"score":10}', 0.5),
        ('{"direction":1,"upvote_ratio":0.9,"score":"junk"}', 0.5),
        ('{"direction":1,"upvote_ratio":0.9,"score":null}', 0.5),
        ('{"normalized_score":"0.7"}', 0.7),
        ('{"direction":1,"upvote_ratio":1,"score":1000}', 1.0),
    ],
)
def test_social_score(spark, payload, want):
    df = spark.createDataFrame([(payload, "t")], "payload string, title string")
    assert df.select(context.social_score().alias("s")).first().s == pytest.approx(want)


def test_unicode_blanks_part_words(spark):
    df = spark.createDataFrame([("strong gains",), ("weak growth",), ("Strong strong loss",)], "t string")
    assert [r.d for r in df.select(text.headline_direction(F.col("t")).alias("d")).collect()] == [1.0, None, None]


def test_one_failing_text_fails_alone(spark):
    def classifier(texts):
        if texts.str.contains("boom").any():
            raise RuntimeError("boom")
        return pd.DataFrame({"direction": "positive", "impact": 0.5, "confidence": 0.5}, index=texts.index)

    df = spark.createDataFrame([(i, f"text {i}" if i else "boom") for i in range(6)], "i int, text string").coalesce(1)
    rows = {r.i: (r.direction, r.cacheable) for r in classification.classify_distinct(df, classifier).collect()}
    assert rows[0] == (classification.UNCERTAIN, False)
    assert all(rows[i] == ("positive", True) for i in range(1, 6))


def test_no_regular_hours_on_weekends_and_holidays(spark):
    days = [("2024-01-05", True), ("2024-01-06", False), ("2024-01-15", False), ("2024-01-16", True)]
    df = spark.createDataFrame([(f"{day} 16:00:00", want) for day, want in days], "at string, want boolean")
    got = df.select(quality.in_regular_session(F.col("at").cast("timestamp")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_good_friday_in_any_century(spark):
    days = ["1970-03-27", "2024-03-29", "2025-04-18", "2199-04-12", "2285-03-20", "2400-04-14"]
    df = spark.createDataFrame([(day,) for day in days], "d string").select(F.col("d").cast("date").alias("d"))
    assert all(r.h for r in df.select(is_holiday(F.col("d")).alias("h")).collect())
    assert trading_calendar(spark, "2024-03-28", "2024-04-01").count() == 2


def test_unknown_sectors_have_no_peers(spark):
    df = spark.createDataFrame([("a", "UNKNOWN", 1.0), ("b", "unknown ", 3.0), ("c", "Tech", 2.0)], "symbol string, sector string, own_return double")
    assert {r.symbol: r.sector_return for r in sector_peers(df).collect()} == {"a": None, "b": None, "c": 2.0}


def test_candidates_name_their_broken_fields(spark):
    columns = "symbol, security_id, exchange, price, median_dollar_volume, spread_pct, volatility, coverage_ratio, listing_sessions"
    rows = [("A", "i", "N", 1.0, 1.0, 0.0, 0.0, 1.0, 1), (" ", "i", "N", float("nan"), 1.0, 0.0, 0.0, 2.0, None)]
    df = spark.createDataFrame(rows, [c.strip() for c in columns.split(",")])
    assert [r.p for r in df.select(candidate_problem().alias("p")).collect()] == [
        None,
        "bad:symbol,bad:price,bad:coverage_ratio,bad:listing_sessions",
    ]


def test_policies_name_the_field():
    with pytest.raises(ValueError, match="fill_ratio"):
        ExecutionProfile(fill_ratio=1.5)
    with pytest.raises(ValueError, match="fx_rate"):
        ExecutionProfile(fx_fee_bps=1.0)
    with pytest.raises(ValueError, match="parts make"):
        CohortPolicy(core=3)
    with pytest.raises(ValueError, match="total"):
        RankingWeights(news=0.5)


def test_python_workers_get_the_package(tmp_path):
    """Queries with Python workers run from an empty folder, without PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from tidemark.session import local_session\n"
        "spark = local_session(2)\n"
        "from tidemark.registry import QUERIES\n"
        "for name in ('walk_forward_model', 'classify_distinct'):\n"
        "    assert QUERIES[name](spark, '/root/testdata/sf0.001').count() >= 0\n"
    )
    env = {key: value for key, value in os.environ.items() if key != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]

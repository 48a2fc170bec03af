import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scores import universe_score
from tidemark.operators import selection, sets, universe
from tidemark.policies import (
    CohortPolicy, ExtendedThresholds, FeatureWindows, FinalistPolicy, RankingWeights, RiskPolicy,
    StrategyPolicy, UniversePolicy,
)
from tidemark.sources import landed  # noqa: F401  (importable without a session)


def candidates(spark, n, seed):
    rng = random.Random(seed)
    rows = [
        (f"S{i:03d}", f"id{i}", "NYSE", "common_stock", rng.choice(["A", "B", "C", "", "UNKNOWN"]),
         rng.choice([50.0, 150.0]), float(rng.choice([0, 10**5, 10**7])), rng.choice([0.001, 0.03]),
         rng.choice([0.01, 0.04]), rng.choice([0.5, 0.95, 1.0]), rng.random() > 0.1)
        for i in range(n)
    ]
    df = spark.createDataFrame(
        rows, "symbol string, security_id string, exchange string, asset_type string, sector string, "
        "price double, median_dollar_volume double, spread_pct double, volatility double, "
        "coverage_ratio double, active boolean")
    return df.withColumns(
        {"provider_resolvable": F.lit(True), "corporate_action_ok": F.lit(True),
         "is_ipo": F.lit(False), "listing_sessions": F.lit(99)})


@pytest.mark.parametrize("seed,target,fraction", [(1, 5, 0.25), (2, 12, 0.3), (3, 60, 0.2), (4, 1, 1.0)])
def test_set_wise_selection_equals_the_greedy_walk(spark, seed, target, fraction):
    policy = UniversePolicy(target=target, max_sector_fraction=fraction)
    df = candidates(spark, 80, seed)
    judged = df.withColumns(
        {"why": universe.eligibility_reason(policy), "s": universe_score(policy)}).collect()
    want, counts, taken = {r.symbol: r.why for r in judged if r.why}, {}, 0
    for r in sorted((r for r in judged if not r.why), key=lambda r: (-r.s, r.symbol)):
        sector = r.sector or "UNKNOWN"
        if taken >= target:
            want[r.symbol] = universe.BELOW_CUTOFF
        elif sector != "UNKNOWN" and counts.get(sector, 0) >= policy.sector_limit:
            want[r.symbol] = universe.SECTOR_LIMIT
        else:
            counts[sector] = counts.get(sector, 0) + 1
            taken += 1
            want[r.symbol] = universe.SELECTED
    got = {r.symbol: r.reason for r in universe.select_universe(df, policy).collect()}
    assert got == want


def test_digest_ignores_order_and_sees_changes(spark):
    df = candidates(spark, 40, 5)
    names = ["symbol", "sector", "price"]
    one = universe.content_digest(df, names).first()["digest"]
    assert universe.content_digest(df.orderBy(F.rand(1)).repartition(7), names).first()["digest"] == one
    other = df.withColumn("price", F.when(F.col("symbol") == "S003", 1.0).otherwise(F.col("price")))
    assert universe.content_digest(other, names).first()["digest"] != one
    assert universe.identity_conflicts(df.unionByName(df.withColumn("security_id", F.lit("x")))).count() == 40


def test_membership_history(spark):
    snaps = spark.createDataFrame(
        [("u1", date(2026, 8, 1), "sec-1", "OLD"), ("u2", date(2026, 9, 1), "sec-1", "NEW")],
        "universe_id string, effective_from date, security_id string, symbol string")
    gone = spark.createDataFrame(
        [("sec-1", date(2026, 9, 10), "acquired")], "security_id string, effective_on date, reason string")
    members = universe.memberships(snaps, gone)
    day = lambda d: F.lit(d).cast("date")
    assert [r.symbol for r in universe.membership_as_of(members, day("2026-09-02")).collect()] == ["NEW"]
    assert universe.membership_as_of(members, day("2026-09-10")).count() == 0
    history = universe.symbol_history(snaps, gone).orderBy("effective_from").collect()
    assert [(r.symbol, str(r.effective_to), r.reason) for r in history] == [
        ("OLD", "2026-09-01", "snapshot"), ("NEW", "2026-09-10", "acquired")]
    assert sets.added_since_previous(snaps).count() == 1


def test_catalog_rules(spark):
    df = spark.createDataFrame(
        [("Acme Inc", "active", True, "NYSE"), ("Acme Warrant", "active", True, "NYSE"),
         ("Acme ETF Trust", "active", True, "ARCA"), ("Acme Fund", "active", True, "NYSE"),
         ("Acme Inc", "inactive", True, "NYSE"), ("Acme Inc", "active", True, "OTC")],
        "name string, status string, tradable boolean, exchange string")
    assert [r.t for r in df.select(universe.asset_type().alias("t")).collect()] == [
        "common_stock", None, "approved_etf", None, None, None]


def test_corrupt_newest_month_gives_no_snapshot(spark):
    schema = "universe_id string, effective_from date, created_at string, valid boolean"
    good = ("a", date(2026, 7, 1), "1", True)
    bad = ("b", date(2026, 8, 1), "2", False)
    as_of = F.lit("2026-08-15").cast("date")
    assert universe.latest_snapshot(spark.createDataFrame([good], schema), as_of).first().universe_id == "a"
    assert universe.latest_snapshot(spark.createDataFrame([good, bad], schema), as_of).count() == 0


def test_cohort_buckets_and_shortfall(spark):
    rows = [("d", f"s{i:02d}", 100.0 - i, True) for i in range(12)] + [("d", "bad", float("nan"), True)]
    df = spark.createDataFrame(rows, "session string, symbol string, rank_score double, valid boolean")
    policy = CohortPolicy(target=9, core=4, boundary=2, diversity=3)
    got = selection.build_cohort(df, policy)
    by = {b: sorted(r.symbol for r in got.filter(F.col("bucket") == b).collect()) for b in ("core", "boundary", "diversity")}
    assert by["core"] == ["S00", "S01", "S02", "S03"] and by["boundary"] == ["S04", "S05"]
    from hashlib import sha256
    rest = sorted((f"S{i:02d}" for i in range(6, 12)), key=lambda s: sha256(f"d:{s}".encode()).hexdigest())
    assert by["diversity"] == sorted(rest[:3])
    assert selection.cohort_shortfall(got, policy).first().shortfall == 0
    assert selection.cohort_shortfall(got, CohortPolicy()).first().shortfall == 21
    ranked = df.filter("symbol <> 'bad'").withColumn("place", F.substring("symbol", 2, 2).cast("int"))
    given = selection.build_cohort(ranked, policy, given_order="place")
    assert sorted(r.symbol for r in given.filter("bucket = 'core'").collect()) == by["core"]
    # Diversity rows keep the position they were given.
    assert {r.symbol: r.rank for r in given.filter("bucket = 'diversity'").collect()} == {
        s: int(s[1:]) + 1 for s in by["diversity"]
    }


def test_kill_switch_blocks_everyone(spark):
    from tidemark.registry.views import candidates_day

    df = candidates_day(spark, "/root/testdata/sf0.001")
    out = selection.evaluate_candidates(df, cash_usd=105.0, policy=StrategyPolicy(), kill_switch=True)
    assert out.select("reason").distinct().first().reason == selection.KILL_SWITCH
    assert out.filter("eligible").count() == 0
    scored = selection.with_rank_score(
        selection.evaluate_candidates(df, cash_usd=105.0, policy=StrategyPolicy(max_spread_pct=0.02)), RankingWeights())
    assert selection.finalists(scored, FinalistPolicy(minimum=5, minimum_rank_score=0.99)).count() == 0


def test_policies_reject_bad_values():
    bad = [
        lambda: UniversePolicy(target=0), lambda: CohortPolicy(target=31), lambda: StrategyPolicy(reward_to_risk=0),
        lambda: RankingWeights(technical=0.9), lambda: RiskPolicy(max_risk_usd=0), lambda: FinalistPolicy(maximum=6),
        lambda: FeatureWindows(volatility_window=1), lambda: ExtendedThresholds(max_pre_range=-1),
    ]
    for make in bad:
        with pytest.raises(ValueError):
            make()
    assert RankingWeights().without("news").technical == pytest.approx(0.7)
    assert RankingWeights().only(("technical", "market")).market == pytest.approx(0.2 / 0.7)

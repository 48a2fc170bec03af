"""Reports and universe build end to end on small tables."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.plans.decision import daily_decision, session_verdict
from tidemark.plans.reports import monthly_report
from tidemark.plans.universe import build_universe
from tidemark.policies import ModelWindows, StrategyPolicy, UniversePolicy
from tidemark.registry.studies import decisions, results
from tidemark.registry.views import candidates_day


def test_monthly_report_has_every_section(spark, sf_dir):
    report = monthly_report(
        decisions(spark, sf_dir), results(spark, sf_dir), "2024-01", windows=ModelWindows(10, 5, 5))
    assert report["version"].first().dataset_version.startswith("2024-01-")
    assert report["quality"].first().sessions > 0
    assert report["ablations"].count() == 5
    assert {r.family for r in report["regimes"].select("family").distinct().collect()} == {
        "market", "stock", "catalyst", "execution_data"}
    assert report["model_rows"].first().status == "READY"
    assert report["model_folds"].filter("accuracy between 0 and 1").count() > 0
    assert {r.selection for r in report["activation_metrics"].collect()} <= {"regular_only", "extended_hours"}


def test_verdict_of_a_session(spark, sf_dir):
    df = candidates_day(spark, sf_dir)
    trade = session_verdict(daily_decision(df, cash_usd=105.0, policy=StrategyPolicy(max_spread_pct=0.02))).first()
    assert trade.decision == "TRADE" and trade.primary_symbol and trade.finalists <= 5
    stopped = session_verdict(daily_decision(df, cash_usd=105.0, kill_switch=True)).first()
    assert stopped.decision == "NO TRADE" and stopped.no_trade_reason


def test_universe_is_built_from_catalog_bars_details_and_quotes(spark):
    names = [f"S{i:02d}" for i in range(12)]
    days = [date(2026, 8, 3) + timedelta(days=i) for i in range(5)]
    assets = spark.createDataFrame(
        [(n, f"{n} Inc", "NYSE", "active", True, ["ipo"] if n == "S01" else []) for n in names],
        "symbol string, name string, exchange string, status string, tradable boolean, attributes array<string>")
    bars = spark.createDataFrame(
        [(n, d, 11.0, 9.0, 10.0, 1000.0 * (i + 1)) for i, n in enumerate(names) for d in days if not (n == "S02" and d != days[0])],
        "symbol string, session_date date, high double, low double, close double, volume double")
    sessions = spark.createDataFrame([(d,) for d in days], "session_date date")
    details = spark.createDataFrame(
        [(n, i, "NYSE", "USD", "Stock", True, n != "S03", "Tech" if i % 2 else " ") for i, n in enumerate(names)],
        "symbol string, symbol_id int, listing_exchange string, currency string, security_type string, is_tradable boolean, is_quotable boolean, industry_sector string")
    quotes = spark.createDataFrame(
        [(i, 9.99, 10.0, n == "S04") for i, n in enumerate(names)],
        "symbol_id int, bid_price double, ask_price double, is_halted boolean")
    policy = UniversePolicy(target=6, max_sector_fraction=0.5)
    rows, header = build_universe(assets, bars, sessions, details, quotes, policy)
    got = {r.symbol: r for r in rows.collect()}
    assert set(got) == set(names) - {"S02", "S03", "S04"}
    assert got["S01"].reason == "IPO seasoning period incomplete"
    members = [r for r in got.values() if r.included]
    assert len(members) == 6 and sum(r.sector == "Tech" for r in members) <= 3
    h = header.first()
    assert h.complete and h.members == 6 and len(h.digest) == 64
    again, header2 = build_universe(assets.orderBy(F.rand(1)), bars.repartition(3), sessions, details, quotes, policy)
    assert header2.first().digest == h.digest

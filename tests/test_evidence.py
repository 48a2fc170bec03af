"""Context merge rules, classification, coverage, journal, research, streaming."""

import random
from datetime import date, datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import (
    audit, classification, context, coverage, journal, model, research,
)
from tidemark.operators.segments import Segmentation
from tidemark.policies import ModelWindows
from tidemark.streaming import quotes as stream

T = datetime(2026, 8, 24, 12, tzinfo=timezone.utc)
RECORD = ("kind string, provider string, external_id string, title string, source_at timestamp, "
          "received_at timestamp, symbols array<string>, url string, payload string")


def record(title, symbols, minute=0, received=None, kind="news", provider="gdelt", ident=None, payload="{}"):
    source = T + timedelta(minutes=minute)
    return (kind, provider, ident or f"{title}{minute}", title, source, T + timedelta(minutes=received if received is not None else minute), symbols, None, payload)


def at(minute):
    return F.lit((T + timedelta(minutes=minute)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")


def test_merge_is_order_free_and_keeps_first_availability(spark):
    rows = [record("Same headline", ["aapl", "AAPL", "msft"], 5), record("same---HEADLINE!!", ["NVDA"], 2, 9),
            record("Same headline", ["msft"], 1, 20), record("Same headline", [], 30)]
    want = None
    for order in (rows, rows[::-1]):
        prepared = context.prepare_records(spark.createDataFrame(order, RECORD))
        content = context.merge_content(prepared).collect()
        links = context.merge_associations(prepared)
        got = (len(content), content[0].external_id, sorted((r.symbol, r.received_at.minute) for r in links.collect()))
        want = want or got
        assert got == want
    assert want == (1, "Same headline5", [("*", 30), ("AAPL", 5), ("MSFT", 5), ("NVDA", 9)])


def test_global_news_replaces_symbol_rows_only_once_known(spark):
    rows = [record("One", ["AAPL"], 1), record("One", [], 10), record("Two", ["AAPL"], 3, kind="filing", ident="f")]
    prepared = context.prepare_records(spark.createDataFrame(rows, RECORD))
    args = (context.merge_content(prepared), context.merge_associations(prepared))
    seen = lambda minute: sorted((r.kind, r.symbol) for r in context.known_records(*args, at(minute)).collect())
    assert seen(0) == []
    assert seen(5) == [("filing", "AAPL"), ("news", "AAPL")]
    known = context.known_records(*args, at(15)).collect()
    assert sorted((r.kind, r.symbol or "") for r in known) == [("filing", "AAPL"), ("news", "")]


def test_scores_use_the_newest_five_of_own_and_shared(spark):
    payload = '{"normalized_score":%s}'
    rows = [record(f"t{i}", ["A"] if i % 2 else [], i, payload=payload % (i / 10)) for i in range(9)]
    prepared = context.prepare_records(spark.createDataFrame(rows, RECORD))
    known = context.known_records(context.merge_content(prepared), context.merge_associations(prepared), at(8))
    symbols = spark.createDataFrame([("A",), ("B",)], "symbol string")
    got = {r.symbol: r for r in context.context_scores(known, symbols, at(8)).collect()}

    def score(i):
        return 0.5 + (i / 10 - 0.5) * 0.5 ** ((8 - i) / 60 / 6)

    assert got["A"].news_score == pytest.approx(np.mean([score(i) for i in (8, 7, 6, 5, 4)]))
    assert got["B"].news_score == pytest.approx(np.mean([score(i) for i in (8, 6, 4, 2, 0)]))
    assert (got["A"].news_count, got["B"].news_count, got["A"].social_score) == (9, 5, None)


def test_payload_readers(spark):
    rows = ['{"direction":"0.7"}', '{"direction":0.7}', '{"direction":"Negative"}', '{"direction":-9}', "{}",
            '{"risk_flags":[" b ","a",""]}', '{"risk_flags":"x"}', '{"impact":"junk"}']
    df = spark.createDataFrame([(i, "filing", "p", "t", p) for i, p in enumerate(rows)], "i int, kind string, provider string, title string, payload string")
    parts = context.catalyst_evidence()
    got = df.select("i", context.direction_of("direction").alias("d"), parts["risk_flags"].alias("f"), parts["magnitude"].alias("m")).orderBy("i").collect()
    assert [r.d for r in got[:5]] == [0.0, 0.7, -1.0, -1.0, None]
    assert got[5].f == ["A", "B"] and got[6].f == ["X"] and got[7].m == 0.5
    risk = context.fundamental_risk()
    assert df.filter("i = 4").select(risk["material_filing"].alias("m"), risk["cash"].alias("c")).first() == (True, None)
    times = spark.sql("select '{\"A\":{\"source_at\":\"2026-01-01T00:00:00Z\",\"received_at\":\"2026-01-02T00:00:00Z\"},\"B\":\"2026-01-03T00:00:00Z\"}' raw, timestamp'2026-01-09' s, timestamp'2026-01-10' r")
    days = [times.select(context.decode_association(F.col("raw"), F.lit(x), F.col("s"), F.col("r")).alias("t")).first().t for x in "ABC"]
    assert [(t.source_at.day, t.received_at.day) for t in days] == [(1, 2), (3, 3), (9, 10)]


def test_each_text_is_classified_once_and_failures_are_not_cached(spark):
    docs = spark.createDataFrame([(i, "good" if i % 2 else "other") for i in range(10)], "id int, text string")

    def classifier(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"direction": ["positive" if t == "good" else "sideways" for t in texts], "impact": 0.5, "confidence": 0.9})

    out = classification.classify_distinct(docs, classifier)
    got = {r.id: (r.direction, r.cacheable) for r in out.collect()}
    assert got[1] == ("positive", True) and got[0] == ("uncertain", False)

    def broken(texts: pd.Series) -> pd.DataFrame:
        raise RuntimeError("down")

    cache = out.filter("cacheable").select("text_hash", F.lit("m").alias("model"), F.lit("v1").alias("prompt_version"), "direction", "impact", "confidence").distinct()
    again = classification.classify_distinct(docs, broken, cache=cache, model="m")
    got = {r.id: (r.direction, r.cacheable) for r in again.collect()}
    assert got[1] == ("positive", True) and got[0] == ("uncertain", False)


def bar(minute, length=1, symbol="A"):
    start = T + timedelta(minutes=minute)
    return (symbol, T.date(), start, start + timedelta(minutes=length))


def statuses(spark, rows, **options):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "symbol string, session_date date, start timestamp, end timestamp, n long")
    keys = spark.createDataFrame([("A", T.date())], "symbol string, session_date date")
    schedule = spark.createDataFrame([(T.date(), T, T + timedelta(minutes=10))], "session_date date, open_at timestamp, close_at timestamp")
    return coverage.coverage_status(df, keys, schedule, **options)


def test_coverage_rules_in_order(spark):
    whole = [bar(i) for i in range(10)]
    cases = [
        (whole, "complete", None), ([], "missing", coverage.NO_BARS), (whole + [bar(3)], "incomplete", coverage.DUPLICATES),
        ([whole[1], whole[0], *whole[2:]], "incomplete", coverage.DISORDER), (whole[:4] + whole[5:], "incomplete", "provider missing 1 minute(s)"),
        (whole[:4] + [bar(4, 2)] + whole[5:], "incomplete", "one-minute coverage gap or wrong range at row 4"),
        (whole + [bar(12)], "complete", None),
    ]
    for rows, status, reason in cases:
        row = statuses(spark, rows, ordinal="n").first()
        assert (row.status, row.reason) == (status, reason)


def test_gaps_need_two_equal_looks(spark):
    gap = [bar(i) for i in range(10) if i not in (3, 4)]
    first, second = statuses(spark, gap), statuses(spark, gap)
    assert coverage.accept_gaps(first, second).first().status == "accepted_gap"
    assert coverage.accept_gaps(first, statuses(spark, gap[:-1])).first().status == "incomplete"
    wide = [bar(i) for i in range(4)]
    assert coverage.accept_gaps(statuses(spark, wide), statuses(spark, wide)).first().status == "incomplete"
    trades = spark.createDataFrame([("A", T + timedelta(minutes=3, seconds=20), False), ("A", T + timedelta(minutes=5), True)], "symbol string, traded_at timestamp, creates_bar boolean")
    assert coverage.accept_gaps(first, second, trades).first().status == "accepted_sparse"
    real = trades.withColumn("creates_bar", F.lit(True))
    assert coverage.accept_gaps(first, second, real).first().status == "incomplete"
    entries = coverage.accept_gaps(first, second)
    assert coverage.audit_exit_code(entries).first().exit_code == 0
    closing = spark.createDataFrame([bar(9), bar(10)], "symbol string, session_date date, start timestamp, end timestamp")
    schedule = spark.createDataFrame([(T.date(), T, T + timedelta(minutes=10))], "session_date date, open_at timestamp, close_at timestamp")
    assert coverage.trim_close_bar(closing, schedule).count() == 1


@pytest.mark.parametrize("minutes", [None, 60])
def test_drawdown_and_ledger_over_segments(spark, minutes):
    rng = random.Random(1)
    returns = [rng.uniform(-0.2, 0.2) for _ in range(400)]
    df = spark.createDataFrame([("g", i, T + timedelta(minutes=7 * i), r) for i, r in enumerate(returns)], "g string, i int, at timestamp, r double")
    equity = peak = 1.0
    worst = 0.0
    for r in returns:
        equity *= 1 + r
        peak = max(peak, equity)
        worst = max(worst, 1 - equity / peak)
    got = research.max_drawdown(df, ["g"], "r", "at", segmentation=Segmentation(minutes)).first().max_drawdown
    assert got == pytest.approx(worst, abs=1e-12)
    lost = df.withColumn("r", F.when(F.col("i") == 5, -1.0).otherwise(F.col("r")))
    assert research.max_drawdown(lost, ["g"], "r", "at").first().max_drawdown == 1.0
    fills = spark.createDataFrame(
        [("a", T, 1, "BUY", 2, 30.0, 0.0), ("a", T + timedelta(minutes=90), 2, "BUY", 2, 30.0, 0.0), ("a", T + timedelta(minutes=200), 3, "SELL", 5, 40.0, 1.0)],
        "account string, filled_at timestamp, sequence int, side string, quantity int, price double, fees double")
    rows = journal.ledger_audit(fills, segmentation=Segmentation(minutes)).orderBy("sequence").collect()
    assert [r.cash for r in rows] == [40.0, -20.0, 179.0]
    assert [(r.second_position, r.over_cash, r.unmatched_sell) for r in rows] == [(False, False, False), (True, True, False), (False, False, True)]
    assert journal.reconstruct_cash(fills).first().cash == 179.0


def test_folds_and_logistic_fit(spark):
    rows = spark.createDataFrame([(f"2026-{i:03d}", "s", "A", i) for i in range(12)], "session string, snapshot_id string, symbol string, k int")
    for cut in (1_000_000, 3):
        folds = model.walk_forward(rows, ModelWindows(6, 2, 2), cut=cut).collect()
        parts = {}
        for r in folds:
            parts.setdefault((r.fold, r.part), []).append(r.row)
        assert {f for f, _ in parts} == {0, 1}
        assert sorted(parts[1, "train"]) == [2, 3, 4, 5, 6, 7] and sorted(parts[1, "holdout"]) == [10, 11]
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 3)), (rng.random(20) > 0.5).astype(float)
    w, b, _, _ = model.fit_logistic(x[None], y[None])
    z = (x - x.mean(0)) / x.std(0)
    weights, bias = [0.0] * 3, 0.0
    for _ in range(500):
        errors = [1 / (1 + np.exp(-(bias + sum(a * v for a, v in zip(weights, row))))) - t for row, t in zip(z, y)]
        bias -= 0.05 * sum(errors) / 20
        for j in range(3):
            weights[j] -= 0.05 * (sum(e * row[j] for e, row in zip(errors, z)) / 20 + 0.01 * weights[j])
    assert w[0] == pytest.approx(weights) and b[0, 0] == pytest.approx(bias)
    scored = spark.createDataFrame([(0.1, 0), (0.9, 1)], "probability double, label int").withColumn("g", F.lit(1))
    m = model.binary_metrics(scored, ["g"]).first()
    assert m.accuracy == 1 and m.brier == pytest.approx(0.01)
    one = spark.createDataFrame([(0.0, 2.0), (float("nan"), 1.0)], "a double, b double")
    p = one.select(model.predict(0.0, [1.0, 0.5], [0.0, 2.0], [1.0, 1.0], ["a", "b"]).alias("p")).collect()
    assert p[0].p == 0.5 and p[1].p is None


def test_evidence_report_needs_fifteen_sessions(spark):
    df = spark.createDataFrame([(f"d{i}", 30, 1, 0, 0.1, 1, True) for i in range(15)], "session string, candidate_rows int, triggered_setups int, paper_trades int, return_sum double, return_count int, complete boolean")
    row = research.evidence_report(df).first()
    assert (row.candidate_rows, row.complete_sessions, row.eligible_for_review) == (450, 15, True)
    assert not research.evidence_report(df.limit(14)).first().eligible_for_review
    ready = spark.createDataFrame([(15, 0.95, 0.9) + (True,) * 6, (14, 0.95, 0.9) + (True,) * 6],
        "complete_sessions int, premarket_coverage_ratio double, postmarket_coverage_ratio double, holdout_consumed boolean, forward_confirmed boolean, manual_approval boolean, reproducible boolean, no_hard_risk_regression boolean, thresholds_frozen boolean")
    assert [r.a for r in ready.select(research.activation_ready().alias("a")).collect()] == [True, False]
    results = spark.createDataFrame([("e", "PROPOSED", 1)], "experiment_id string, status string, recorded_at int")
    done = spark.createDataFrame([("e", "NO CHANGE", 1), ("e", "PROMOTED", 2)], "experiment_id string, result string, recorded_at int")
    assert research.experiment_status(results, done).first().status == "PROMOTED"


def test_audit_statuses(spark):
    manifest = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("/etc/x", "1")], "file string, digest string")
    stored = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "file string, digest string")
    got = {r.file: r.status for r in audit.audit_files(manifest, stored).collect()}
    assert got == {"a": "ok", "b": "checksum mismatch", "c": "missing", "d": "undeclared", "/etc/x": "unsafe path"}


def test_report_views(spark):
    reports = spark.createDataFrame([("s1", "d1", T, 1, "TRADE", "OPEN", "A", None), ("s2", "d1", T, 2, "TRADE", "OPEN", "B", "x")],
        "snapshot_id string, session string, created_at timestamp, report_order int, decision string, state string, primary_symbol string, version string")
    assert journal.first_report(reports).first().snapshot_id == "s1"
    assert journal.latest_report(reports).first().snapshot_id == "s2"
    masked = journal.mask_stale(reports, F.lit("d2")).first()
    assert (masked.decision, masked.state, masked.primary_symbol) == ("NO TRADE", "STALE", None)
    rows = spark.createDataFrame([("s2", None), ("s2", "own")], "snapshot_id string, version string")
    assert sorted(r.version for r in journal.with_report_metadata(rows, reports, ["version", "decision"]).collect()) == ["own", "x"]


def test_streams_are_idempotent(spark, tmp_path):
    schema = "symbol string, received_at timestamp, last_trade_price double, event_id long"
    rows = [("A", T, 1.0, 1), ("A", T, 1.0, 1), ("A", T + timedelta(minutes=1), 2.0, 2), ("B", T, 3.0, 3)]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(source)
    live = stream.landed_quotes(spark, source, schema, pattern="*.parquet")
    unique = stream.without_duplicates(live, ["symbol", "received_at"])
    for _ in range(2):
        stream.run_available(unique, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    query = (stream.latest_state(live).writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start())
    query.awaitTermination()
    assert {r.symbol: r.last_trade_price for r in spark.table("latest").collect()} == {"A": 2.0, "B": 3.0}
    target = str(tmp_path / "first")
    write = stream.keep_first(target, ["symbol"], ["received_at", "event_id"])
    for checkpoint in ("a", "b"):
        (live.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination())
    assert {r.symbol: r.last_trade_price for r in spark.read.parquet(target).collect()} == {"A": 1.0, "B": 3.0}
    assert date(2026, 8, 24) == T.date()

"""Landed JSON payloads and partitioned tables."""

import json
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidemark.operators import quality, universe
from tidemark.sources import landed, tables


def land(tmp_path, *responses):
    path = tmp_path / "landed.json"
    path.write_text("\n".join(json.dumps(r) for r in responses))
    return str(path)


def utc(*parts):
    return datetime(*parts, tzinfo=timezone.utc)


def test_quotes_carry_source_time_and_latency(spark, tmp_path):
    quote = {"symbol": "amd", "symbolId": 7, "bidPrice": 9.9, "askPrice": 10.1, "lastTradePrice": 10.0,
             "volume": 5, "delay": 0, "isHalted": False}
    path = land(
        tmp_path,
        {"received_at": "2026-08-24T13:30:02.500Z", "date_header": "Mon, 24 Aug 2026 13:30:00 GMT", "quotes": [quote]},
        {"received_at": "2026-08-24T13:31:00Z", "date_header": "junk", "quotes": [quote, {**quote, "symbol": "x"}]},
        {"received_at": "2026-08-24T13:32:00Z", "date_header": "Mon, 24 Aug 2026 13:32:05 GMT", "quotes": [quote]},
    )
    rows = landed.quotes(spark, path).orderBy("received_at", "symbol").collect()
    assert [(r.symbol, r.source_time_origin, r.latency_ms) for r in rows] == [
        ("AMD", "http_date", 2500), ("AMD", "received_proxy", 0), ("X", "received_proxy", 0), ("AMD", "http_date", 0)]
    verdicts = {r.invalid_reason for r in quality.classify_quotes(landed.quotes(spark, path)).collect()}
    assert verdicts == {None, "SOURCE_TIME_UNVERIFIED"}


def test_details_search_and_schedules(spark, tmp_path):
    detail = {"symbol": "amd", "symbolId": 7, "listingExchange": "nasdaq", "currency": "usd", "securityType": "Stock",
              "isTradable": True, "isQuotable": True}
    path = land(tmp_path, {"symbols": [detail, {**detail, "symbol": "b", "currency": "CAD"}]})
    assert [r.symbol for r in landed.symbol_details(spark, path).filter(universe.usable_detail()).collect()] == ["AMD"]
    path = land(tmp_path, {"prefix": "AMD", "symbols": [
        {"symbol": "AMD", "symbolId": 1, "isTradable": False, "isQuotable": True},
        {"symbol": "amd", "symbolId": 2, "isTradable": True, "isQuotable": True},
        {"symbol": "AMD", "symbolId": 3, "isTradable": True, "isQuotable": True}]})
    asked = spark.createDataFrame([(" amd ",), ("nope",)], "symbol string")
    got = {r.symbol: r.symbol_id for r in quality.resolve_symbols(asked, landed.search_hits(spark, path)).collect()}
    assert got == {"AMD": 2, "NOPE": None}
    market = {"name": "NYSE", "currency": "USD", "extendedStartTime": "2026-08-24T08:00:00Z", "startTime": "2026-08-24T13:30:00Z",
              "endTime": "2026-08-24T20:00:00Z", "extendedEndTime": "2026-08-25T00:00:00Z"}
    shifted = {**market, "startTime": "2026-08-25T13:31:00Z", "extendedStartTime": "2026-08-25T08:00:00Z",
               "endTime": "2026-08-25T20:00:00Z", "extendedEndTime": "2026-08-25T23:59:00Z"}
    path = land(tmp_path, {"markets": [{**market, "extendedEndTime": "2026-08-24T23:59:00Z"}, {**market, "currency": "CAD"},
                                       {**market, "endTime": None}]},
                {"markets": [shifted, {**shifted, "endTime": "2026-08-25T19:00:00Z"}]})
    rows = landed.market_schedules(spark, path).orderBy("session").collect()
    assert [(str(r.session), r.agreed) for r in rows] == [("2026-08-24", True), ("2026-08-25", False)]


def test_history_payloads(spark, tmp_path):
    path = land(tmp_path, {"symbol": "amd", "bars": [{"t": "2026-08-24T13:30:00Z", "o": 1, "h": 2, "l": 1, "c": 2, "v": 5}]})
    bar = landed.candles(spark, path).first()
    assert bar.end - bar.start == timedelta(minutes=1) and bar.session_date == date(2026, 8, 24)
    path = land(tmp_path, {"symbol": "amd", "trades": [
        {"t": "2026-08-24T13:30:10Z", "c": ["@"], "z": "C", "s": 5}, {"t": "2026-08-24T13:30:10Z", "c": ["C"], "z": "C", "s": 5},
        {"t": "2026-08-24T13:30:10Z", "c": ["B"], "z": "A", "s": 5}, {"t": "2026-08-24T13:30:10Z", "c": ["?"], "z": "A", "s": 0},
        {"t": "2026-08-24T13:30:10Z", "c": ["@"], "z": "C", "s": 0}, {"t": "2026-08-24T13:30:10Z", "z": "C", "s": 1}]})
    rows = landed.trades(spark, path).select(quality.can_create_bar(F.col("conditions"), F.col("tape"), F.col("size")).alias("b"))
    assert [r.b for r in rows.collect()] == [True, False, False, True, False, True]
    path = land(tmp_path, {"bars": {"amd": [
        {"t": "2026-08-24T04:00:00Z", "h": 2, "l": 1, "c": 2, "v": 5}, {"t": "bad", "h": 2, "l": 1, "c": 2, "v": 5},
        {"t": "2026-08-25T04:00:00Z", "h": "x", "l": 1, "c": 2, "v": 5}], "other": []}})
    assert [str(r.session_date) for r in landed.daily_bars(spark, path).collect()] == ["2026-08-24"]
    path = land(tmp_path, {"id": "1", "symbol": " amd ", "exchange": "nasdaq", "status": "ACTIVE", "tradable": True, "name": "Amd Inc"},
                {"symbol": "noid"})
    asset = landed.assets(spark, path).collect()
    assert [(a.symbol, a.exchange, a.status) for a in asset] == [("AMD", "NASDAQ", "active")]


def test_context_payloads(spark, tmp_path):
    path = land(tmp_path, {"received_at": "2026-08-24T13:30:00Z", "symbols": ["AMD"], "articles": [
        {"title": " Up ", "url": "http://a", "seendate": "20260824T120000Z"}, {"title": "  ", "url": "http://b"},
        {"title": "No link", "url": "", "seendate": "?"}]})
    rows = landed.news(spark, path).orderBy("title").collect()
    assert [r.title for r in rows] == ["No link", "Up"]
    assert rows[1].source_at == datetime(2026, 8, 24, 12) and len(rows[0].external_id) == 64
    path = land(tmp_path, {"received_at": "2026-08-24T13:30:00Z", "series_id": "CPI", "observations": [
        {"date": "2026-07-01", "value": "1.5", "realtime_start": "2026-08-10", "realtime_end": "9999-12-31"}]})
    row = landed.macro(spark, path).first()
    assert row.external_id == "CPI:2026-07-01:2026-08-10" and row.source_at == datetime(2026, 8, 10)
    path = land(tmp_path, {"received_at": "2026-08-24T13:30:00Z", "cik": 12, "tickers": ["AMD"], "filings": {"recent": {
        "accessionNumber": ["0-1-2", " ", "3"], "form": ["10-Q", "8-K"], "filingDate": ["2026-08-01", "2026-08-02"],
        "acceptanceDateTime": ["2026-08-01T20:00:00Z"], "primaryDocument": ["a.htm"]}}})
    rows = {r.external_id: r for r in landed.filings(spark, path).collect()}
    assert set(rows) == {"0-1-2", "3"}
    assert json.loads(rows["0-1-2"].payload)["catalyst_family"] == "EARNINGS"
    assert rows["0-1-2"].url.endswith("12/012/a.htm") and rows["3"].url is None
    assert rows["3"].title == "SEC filing" and rows["3"].source_at == rows["3"].received_at
    assert landed.filings(spark, path, forms=["8-K"]).count() == 0
    post = {"id": "p1", "title": "buy $AMD $amd $zzz", "created_utc": 1787577600.0, "score": 99999, "num_comments": -3, "upvote_ratio": 0.9}
    path = land(tmp_path, {"received_at": "2026-08-24T13:30:00Z", "subreddit": "s", "data": {"children": [
        {"data": post}, {"data": {**post, "id": "p2", "removed_by_category": "mod"}}, {"data": {**post, "id": "p3", "title": "none"}},
        {"data": {**post, "id": "p4", "created_utc": 2e9}}]}})
    rows = landed.social(spark, path, ["AMD", "NVDA"]).collect()
    assert [(r.external_id, r.symbols) for r in rows] == [("p1", ["AMD"])]
    assert json.loads(rows[0].payload)["score"] == 10_000 and json.loads(rows[0].payload)["num_comments"] == 0


def test_lists_and_catalogs(spark, tmp_path):
    path = tmp_path / "list.txt"
    path.write_text("# comment\n amd \n\nnvda\n")
    assert sorted(r.symbol for r in landed.symbol_list(spark, str(path)).collect()) == ["AMD", "NVDA"]
    one = {"symbol": "A", "security_id": "1", "exchange": "NYSE", "price": 5.0}
    path = land(tmp_path, one, {"candidates": [{**one, "symbol": "B"}, {**one, "symbol": "C"}]})
    assert sorted(r.symbol for r in landed.candidate_catalog(spark, path).collect()) == ["A", "B", "C"]


def minute_bars(spark, day="2026-08-24", shift=0.0):
    rows = [("AMD", utc(2026, 8, 24, 13, 30 + i), utc(2026, 8, 24, 13, 31 + i), 10.0, 11.0, 9.0, 10.0 + shift, 5, "history", "sip") for i in range(3)]
    rows.append(("AMD", utc(2026, 8, 24, 2, 0), utc(2026, 8, 24, 2, 1), 10.0, 11.0, 9.0, 10.0, 5, "history", "sip"))
    return spark.createDataFrame(rows, "symbol string, start timestamp, end timestamp, open double, high double, low double, close double, volume long, provider string, feed string")


def test_candles_are_partitioned_and_pruned(spark, tmp_path):
    root = str(tmp_path / "candles")
    tables.write_candles(minute_bars(spark), root)
    tables.write_candles(minute_bars(spark, shift=0.5), root)
    since = F.lit("2026-08-24 13:31:00").cast("timestamp")
    bars = tables.replay_bars(spark, root, symbol="amd", session="2026-08-24", since=since)
    assert [r.close for r in bars.collect()] == [10.5, 10.5]
    plan = bars._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(provider" in plan and "PushedFilters" in plan
    inside, outside = tables.split_candles(minute_bars(spark))
    assert (inside.count(), outside.count()) == (3, 1)
    with pytest.raises(Exception, match="unsafe partition value"):
        tables.write_candles(minute_bars(spark).withColumn("feed", F.lit("../x")), root)


def test_immutable_rows(spark, tmp_path):
    path = str(tmp_path / "decisions")
    rows = spark.createDataFrame([("s1", f"S{i}", float(i)) for i in range(3)], "snapshot_id string, symbol string, score double")
    assert tables.write_decisions(rows, path, cohort_rows=3) == 3
    assert tables.write_decisions(rows, path, cohort_rows=3) == 0
    with pytest.raises(ValueError, match="different content"):
        tables.write_decisions(rows.withColumn("score", F.col("score") + 1), path, cohort_rows=3)
    with pytest.raises(ValueError, match="exactly 30"):
        tables.write_decisions(rows, path)
    with pytest.raises(ValueError, match="repeat a key"):
        tables.write_outcomes(rows.unionByName(rows), path)
    report = str(tmp_path / "report")
    tables.write_once(rows, report)
    tables.write_once(rows.orderBy(F.desc("symbol")), report)
    with pytest.raises(ValueError, match="different data"):
        tables.write_once(rows.limit(1), report)


def test_insert_if_absent_and_history(spark, tmp_path):
    path = str(tmp_path / "quotes")
    rows = spark.createDataFrame(
        [(7, "AMD", utc(2026, 8, 24, 13, 30), "live", 10.0), (7, "AMD", utc(2026, 8, 24, 13, 30), "live", 11.0),
         (7, "AMD", utc(2026, 8, 24, 13, 32), "live", 12.0)],
        "symbol_id long, symbol string, received_at timestamp, provider string, last_trade_price double")
    keys = ["symbol_id", "received_at", "provider"]
    tables.append_absent(rows, path, keys, ["last_trade_price"])
    tables.append_absent(rows.withColumn("last_trade_price", F.lit(1.0)), path, keys)
    assert sorted(r.last_trade_price for r in spark.read.parquet(path).collect()) == [10.0, 12.0]
    out = str(tmp_path / "export")
    tables.export_quotes(spark.read.parquet(path), out, F.lit("2026-08-24 13:31:00").cast("timestamp"))
    seen = tables.quote_history(spark, out, "amd", F.lit("2026-08-25").cast("timestamp"))
    assert [r.last_trade_price for r in seen.collect()] == [10.0]


def test_features_need_one_version(spark, tmp_path):
    rows = spark.createDataFrame([("AMD", utc(2026, 8, 24, 13, 30), "v1"), ("AMD", utc(2026, 8, 24, 13, 31), "v1")],
                                 "symbol string, received_at timestamp, feature_version string")
    tables.write_features(rows, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    with pytest.raises(Exception):
        tables.write_features(rows.withColumn("feature_version", F.lit(None).cast("string")), str(tmp_path / "f"))
    mixed = rows.unionByName(rows.withColumn("feature_version", F.lit("v2")))
    with pytest.raises(ValueError):
        tables.write_features(mixed, str(tmp_path / "f"))


def test_snapshots_verify_their_checksum(spark, tmp_path):
    root = str(tmp_path / "universe")
    rows = spark.createDataFrame([("A", "1", "NYSE", "common_stock", "X", 0.5, True, "selected")],
                                 "symbol string, security_id string, exchange string, asset_type string, sector string, score double, included boolean, reason string")
    universe_id = tables.write_snapshot(rows, root, "2026-08-01")
    _, headers = tables.read_snapshots(spark, root)
    assert [(h.universe_id, h.valid) for h in headers.collect()] == [(universe_id, True)]
    broken = spark.read.parquet(root).withColumns({"universe_id": F.lit("US-bad"), "symbol": F.lit("Z")})
    broken.write.mode("append").partitionBy("universe_id").parquet(root)
    _, headers = tables.read_snapshots(spark, root)
    assert {h.universe_id: h.valid for h in headers.collect()} == {universe_id: True, "US-bad": False}


def test_small_tables(spark, tmp_path):
    batches = spark.createDataFrame([("2026-08-24", "p", "A", 1), ("2026-08-24", "p", "A", 2), ("2026-08-24", "p", "B", 2)],
                                    "as_of string, provider string, symbol string, batch int")
    assert tables.manifest_union(batches).count() == 2
    log = str(tmp_path / "log")
    tables.record_collection(spark, log, {"run_at": utc(2026, 8, 24), "record_count": 3, "errors": ["x"], "versions": {"a": "1"}})
    assert spark.read.parquet(log).first().record_count == 3
    sched = spark.createDataFrame([(date(2026, 8, 24), "one")], "session date, source string")
    tables.archive_schedules(sched, str(tmp_path / "s"))
    tables.archive_schedules(sched.withColumn("source", F.lit("two")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first().source == "one"
    payload = spark.createDataFrame([("s", "A", "2026-08", '{"status":"complete","net_return":0.1}')],
                                    "snapshot_id string, symbol string, month string, payload string")
    payload.write.parquet(str(tmp_path / "m"))
    row = tables.month_rows(spark, str(tmp_path / "m"), "2026-08", "status string, net_return double").first()
    assert (row.status, row.net_return) == ("complete", 0.1)

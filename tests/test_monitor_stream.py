"""The five-minute monitor as a stream: at once, corrected, bounded state."""

import datetime as dt
import json
import os

import pytest

from tidemark.operators import monitoring
from tidemark.streaming import quotes as stream

SCHEMA = (
    "symbol string, session_date date, received_at timestamp, event_id long, last_trade_price double, "
    "bid_price double, ask_price double, volume double"
)
START = dt.datetime(2024, 5, 6, 14, 0)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def quote(symbol, seconds, event, price):
    return (symbol, START.date(), START + dt.timedelta(seconds=seconds), event, price, 1.0, 2.0, 3.0)


def selections(spark):
    rows = [("s1", "A", START.date(), "PRIMARY", 1, 100.0, 95.0, 110.0), ("s2", "B", START.date(), "BACKUP", 2, 50.0, 45.0, 60.0), ("s3", "A", START.date(), "BACKUP", 3, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "snapshot_id string, symbol string, session_date date, role string, final_rank int, decision_price double, stop double, target double")


def rows_of(df):
    names = ["snapshot_id", "symbol", "bucket_at", "received_at", "return_pct", "mfe_pct", "mae_pct", "target_hit", "stop_hit", "role"]
    return sorted((tuple(row) for row in df.select(*names).collect()), key=str)


def test_every_batch_is_seen_at_once_and_late_rows_correct_it(spark, tmp_path, rocks):
    source, target, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    batches = [
        [quote("A", 10, 1, 101.0), quote("A", 20, 2, 50.0), quote("B", 400, 3, 61.0), quote("Z", 1, 9, 1.0)],
        [quote("A", 310, 4, 94.0), quote("A", 5, 5, 103.0), quote("B", 5, 6, 44.0)],  # two of them late
        [quote("A", 310, 0, 120.0), quote("A", 650, 7, None), quote("A", 700, 8, 130.0)],  # an equal time
    ]
    seen = []
    for number, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live = stream.landed_quotes(spark, source, SCHEMA)
        stream.run_updates(stream.monitor_updates(live, selections(spark)), target, checkpoint)
        seen += batch
        got = stream.newest_versions(spark, target, stream.MONITOR_KEY, stream.MONITOR_SCHEMA)
        want = monitoring.monitor(spark.createDataFrame(seen, SCHEMA), selections(spark))
        assert rows_of(got) == rows_of(want), number
    assert len(rows_of(got)) == 5


def test_closed_buckets_keep_their_extremes_and_leave_the_state(spark, tmp_path, rocks):
    source, target, checkpoint = (str(tmp_path / name) for name in ("in", "out", "cp"))
    for batch in ([quote("A", 0, 1, 120.0), quote("A", 301, 2, 90.0)], [quote("A", 4000, 3, 100.0)], [quote("A", 3, 4, 500.0), quote("A", 4300, 5, 101.0)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        live = stream.landed_quotes(spark, source, SCHEMA)
        stream.run_updates(stream.monitor_updates(live, selections(spark)), target, checkpoint)
    got = rows_of(stream.newest_versions(spark, target, stream.MONITOR_KEY, stream.MONITOR_SCHEMA))
    # The quote of 500 came over an hour late: dropped.
    assert [(row[5], round(row[6], 6)) for row in got] == [(pytest.approx(20.0), 0.0), (pytest.approx(20.0), -10.0), (pytest.approx(20.0), -10.0), (pytest.approx(20.0), -10.0)]
    store = spark.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    assert store.count() <= 2
    assert os.path.isdir(f"{target}/batch=0") and json.dumps(got, default=str)

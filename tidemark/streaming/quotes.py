"""Quote streams: idempotent ingest, monitoring, latest state, one decision per session."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from tidemark.operators.monitoring import (
    best_selection,
    selected_quotes,
    with_return,
)
from tidemark.shared import ship_package

WATERMARK = "10 minutes"


def landed_quotes(
    spark: SparkSession, folder: str, schema: StructType | str, *, pattern: str = "*",
    format: str = "parquet", files_per_trigger: int | None = None,
) -> DataFrame:
    """Files landed in a folder as a stream."""
    reader = spark.readStream.schema(schema).format(format).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def without_duplicates(quotes: DataFrame, keys: list[str], delay: str = WATERMARK) -> DataFrame:
    """Insert-if-absent on the quote key; state is dropped behind the watermark."""
    return quotes.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(keys)


BUCKET_US = 300_000_000
_VALUE = (
    "received_us long, tie long, role string, last_trade_price double, bid_price double, "
    "ask_price double, volume double, return_pct double, target_hit boolean, stop_hit boolean"
)
_VALUES = [each.split()[0] for each in _VALUE.split(", ")]
_ARRIVING = f"snapshot_id string, symbol string, received_at timestamp, bucket_us long, {_VALUE}"
MONITOR_KEY = ["snapshot_id", "symbol", "bucket_at"]
MONITOR_SCHEMA = (
    "snapshot_id string, symbol string, bucket_at timestamp, received_at timestamp, role string, "
    "last_trade_price double, bid_price double, ask_price double, volume double, "
    "return_pct double, mfe_pct double, mae_pct double, target_hit boolean, stop_hit boolean"
)


def _first_per_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        ordered = batch.sort_values(["received_us", "tie"], kind="stable")
        yield ordered.drop_duplicates(["snapshot_id", "symbol", "bucket_us"])


class BucketMonitor(StatefulProcessor):
    """First observation of each five-minute bucket with the extremes up to it, emitted at once.

    State per (snapshot, symbol): a map of the buckets that may still change, and two numbers for
    those that may not. An observation that arrives later but was received earlier replaces its
    bucket's; the bucket and all later open ones are emitted again. A timer at the end of each
    bucket fires once the watermark has passed it; the bucket then leaves the map. State in event
    time has no time to live of its own, the timers bound it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "bucket_us long", _VALUE)
        self.closed = handle.getValueState("closed", "mfe double, mae double")

    def _extremes(self) -> tuple[float, float]:
        return tuple(self.closed.get()) if self.closed.exists() else (0.0, 0.0)

    def _buckets(self) -> list[tuple[int, tuple]]:
        return sorted((int(key[0]), tuple(value)) for key, value in self.open.iterator())

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any
    ) -> Iterator[pd.DataFrame]:
        changed = None
        for batch in _first_per_bucket(rows):
            for row in batch.astype(object).where(batch.notna(), None).itertuples(index=False):
                bucket = (int(row.bucket_us),)
                value = tuple(getattr(row, name) for name in _VALUES)
                if self.open.containsKey(bucket):
                    if tuple(self.open.getValue(bucket))[:2] <= value[:2]:
                        continue
                else:
                    self.handle.registerTimer((bucket[0] + BUCKET_US) // 1000)
                self.open.updateValue(bucket, value)
                changed = bucket[0] if changed is None else min(changed, bucket[0])
        if changed is not None:
            yield self._versions(key, changed)

    def _versions(self, key: Any, since: int) -> pd.DataFrame:
        """The open buckets from `since` on, with running extremes."""
        mfe, mae = self._extremes()
        out = []
        for bucket, value in self._buckets():
            row = dict(zip(_VALUES, value))
            if row["return_pct"] is not None:
                mfe, mae = max(mfe, row["return_pct"]), min(mae, row["return_pct"])
            if bucket >= since:
                row |= {"snapshot_id": key[0], "symbol": key[1], "mfe_pct": mfe, "mae_pct": mae}
                row |= {"bucket_at": bucket, "received_at": row["received_us"]}
                out.append(row)
        frame = pd.DataFrame(out, columns=[each.split()[0] for each in MONITOR_SCHEMA.split(", ")])
        for name in ("bucket_at", "received_at"):
            frame[name] = pd.to_datetime(frame[name].astype("int64"), unit="us")
        return frame

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        ended = expiredTimerInfo.getExpiryTimeInMs() * 1000
        mfe, mae = self._extremes()
        for bucket, value in self._buckets():
            if bucket + BUCKET_US > ended:
                break
            gain = value[_VALUES.index("return_pct")]
            if gain is not None:
                mfe, mae = max(mfe, gain), min(mae, gain)
            self.open.removeKey((bucket,))
        self.closed.update((mfe, mae))
        yield from ()

    def close(self) -> None:
        pass


def monitor_updates(
    quotes: DataFrame, selections: DataFrame, tie_break: str = "event_id", delay: str = WATERMARK
) -> DataFrame:
    """Versions of monitored buckets (MONITOR_SCHEMA), the newest of each key counts.

    `quotes` is a stream; `selections` is static and reduced to its best row per session and
    symbol before the join. Every task reduces its rows to one per bucket before they are
    shuffled, so a symbol with most of the quotes is no hot group. Quotes that come more than
    `delay` behind the newest one are dropped.
    """
    ship_package(quotes.sparkSession)
    at = F.unix_micros("received_at")
    priced = with_return(selected_quotes(quotes, best_selection(selections)))
    arriving = priced.select(
        "snapshot_id", "symbol", "received_at", (F.floor(at / BUCKET_US) * BUCKET_US).cast("long").alias("bucket_us"),
        at.alias("received_us"), F.col(tie_break).cast("long").alias("tie"), "role",
        *[F.col(name).cast("double").alias(name) for name in ("last_trade_price", "bid_price", "ask_price", "volume", "return_pct")],
        "target_hit", "stop_hit",
    )
    first = arriving.mapInPandas(_first_per_bucket, _ARRIVING).withWatermark("received_at", delay)
    return first.groupBy("snapshot_id", "symbol").transformWithStateInPandas(
        statefulProcessor=BucketMonitor(),
        outputStructType=MONITOR_SCHEMA,
        outputMode="Update",
        timeMode="EventTime",
    )


def run_updates(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Process everything landed so far; each batch's versions are a folder of their own.

    A batch that runs again writes the same folder, so nothing is doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    (
        stream.writeStream.foreachBatch(write)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def newest_versions(spark: SparkSession, target: str, key: list[str], schema: str) -> DataFrame:
    """The newest version of each key that `run_updates` has written."""
    read = spark.read.schema(f"{schema}, batch long").parquet(target)
    rest = [name for name in read.columns if name not in (*key, "batch")]
    return read.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("__r")).select(*key, "__r.*")


def latest_state(quotes: DataFrame, tie_break: str = "event_id") -> DataFrame:
    """Newest quote per symbol for update or complete mode."""
    newest = F.max_by(
        F.struct("received_at", "last_trade_price", tie_break), F.struct("received_at", tie_break)
    )
    return quotes.groupBy("symbol").agg(newest.alias("quote")).select("symbol", "quote.*")


def keep_first(target: str, key: list[str], order: list[str]):
    """A foreachBatch writer in which the first row per key ever written stays.

    The batch is reduced to its first row per key and anti-joined with the table, so a
    replayed batch adds nothing.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        rest = [name for name in batch.columns if name not in key]
        first = batch.groupBy(*key).agg(
            F.min_by(F.struct(*rest), F.struct(*order)).alias("__r")
        ).select(*key, "__r.*")
        spark = batch.sparkSession
        try:
            known = spark.read.schema(first.schema).parquet(target).select(*key)
            first = first.join(known, key, "left_anti")
        except Exception as exc:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(exc):
                raise
        first.write.mode("append").parquet(target)

    return write


def run_available(stream: DataFrame, target: str, checkpoint: str, *, mode: str = "append") -> None:
    """Process everything landed so far into a Parquet table and stop."""
    (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )

"""Partitioned tables: candles, quotes, features, immutable research rows, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import REGULAR, SCHEDULE_SOURCE, exchange_date, session_phase
from tidemark.operators.quality import safe_partition_value
from tidemark.operators.universe import content_digest
from tidemark.sources.versions import BUCKETS, read_buckets, upsert

COHORT_ROWS = 30


def _missing(exc: Exception) -> bool:
    return "PATH_NOT_FOUND" in str(exc)


def read_if_present(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # noqa: BLE001
        if _missing(exc):
            return None
        raise


def _clustered(df: DataFrame, partition: Sequence[str], sort: Sequence[str]) -> DataFrame:
    """Range-partition by (partition, sort): even files, symbols clustered inside them."""
    return df.repartitionByRange(*partition, *sort).sortWithinPartitions(*partition, *sort)


def _checked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail the write when a partition value is not a safe path part."""
    safe = F.lit(True)
    for name in columns:
        safe = safe & safe_partition_value(F.col(name).cast("string"))
    return df.filter(
        F.when(F.coalesce(safe, F.lit(False)), F.lit(True)).otherwise(
            F.raise_error(F.lit("unsafe partition value")).cast("boolean")
        )
    )


def split_candles(candles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candles with phase, session and schedule columns, and those outside every phase."""
    start = F.col("start")
    labelled = candles.withColumns(
        {
            "session_phase": session_phase(start),
            "session_date": exchange_date(start),
            "schedule_source": F.lit(SCHEDULE_SOURCE),
        }
    )
    return (
        labelled.filter("session_phase IS NOT NULL"),
        labelled.filter("session_phase IS NULL"),
    )


CANDLE_PARTITIONS = ["provider", "feed", "interval", "date"]


def write_candles(candles: DataFrame, root: str, interval: str = "OneMinute") -> None:
    """Replace exactly the partitions present in the data.

    `symbol` is clustered inside the files rather than a directory level: one directory per
    symbol and day would mean millions of tiny files.
    """
    inside, _ = split_candles(candles)
    rows = inside.withColumns(
        {"interval": F.lit(interval), "date": F.col("session_date").cast("string")}
    )
    (
        _clustered(_checked(rows, CANDLE_PARTITIONS), CANDLE_PARTITIONS, ["symbol", "start"])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*CANDLE_PARTITIONS)
        .parquet(root)
    )


def replay_bars(
    spark: SparkSession,
    root: str,
    *,
    symbol: str,
    session: str,
    since: Column,
    provider: str = "history",
    feed: str = "sip",
    interval: str = "OneMinute",
) -> DataFrame:
    """One symbol's regular bars from a cutoff on; partitions and row groups are pruned."""
    return (
        spark.read.parquet(root)
        .filter(
            (F.col("provider") == provider)
            & (F.col("feed") == feed)
            & (F.col("interval") == interval)
            & (F.col("date") == session)
            & (F.col("symbol") == symbol.upper())
            & (F.col("session_phase") == REGULAR)
            & (F.col("start") >= since)
        )
        .orderBy("start")
    )


def export_quotes(quotes: DataFrame, root: str, as_of: Column) -> None:
    """Quotes known by a time, by receipt date."""
    rows = quotes.filter(F.col("received_at") <= as_of).withColumn(
        "date", F.date_format("received_at", "yyyy-MM-dd")
    )
    (
        _clustered(rows, ["date"], ["symbol", "received_at"])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("date")
        .parquet(root)
    )


def quote_history(spark: SparkSession, root: str, symbol: str, as_of: Column) -> DataFrame:
    return (
        spark.read.parquet(root)
        .filter((F.col("symbol") == symbol.strip().upper()) & (F.col("received_at") <= as_of))
        .orderBy("received_at")
    )


def write_features(features: DataFrame, root: str) -> None:
    """Features by version and date; a null version fails the write."""
    rows = features.withColumns(
        {
            "date": F.date_format("received_at", "yyyy-MM-dd"),
            "feature_version": F.coalesce(
                F.col("feature_version"), F.raise_error(F.lit("feature version is required"))
            ),
        }
    )
    versions = rows.agg(F.count_distinct("feature_version").alias("n")).first()["n"]
    if versions != 1:
        raise ValueError("a feature dataset must hold exactly one feature version")
    (
        _clustered(_checked(rows, ["feature_version"]), ["feature_version", "date"], ["symbol", "received_at"])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("feature_version", "date")
        .parquet(root)
    )


def append_absent(rows: DataFrame, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    """Insert rows whose key is not stored yet; inside the batch one row per key is kept."""
    rest = [name for name in rows.columns if name not in keys]
    ranking = F.struct(*(list(order) or rest))
    batch = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), ranking).alias("__r")).select(
        *keys, "__r.*"
    )
    stored = read_if_present(rows.sparkSession, path, batch.schema)
    if stored is not None:
        batch = batch.join(stored.select(*keys), list(keys), "left_anti")
    batch.select(*rows.columns).write.mode("append").parquet(path)


def append_immutable(
    rows: DataFrame, path: str, keys: Sequence[str], *, group: str | None = None,
    group_rows: int | None = None,
) -> int:
    """Append rows that may never change.

    Re-writing equal rows is a no-op; a stored key with different content, a repeated key, or
    a group without exactly `group_rows` rows is an error. Returns the rows added.
    """
    keys = list(keys)
    rest = [name for name in rows.columns if name not in keys]
    duplicate = rows.groupBy(*keys).count().filter("count > 1").limit(1).count()
    if duplicate:
        raise ValueError("immutable rows repeat a key")
    if group is not None:
        wrong = rows.groupBy(group).count().filter(F.col("count") != group_rows).limit(1).count()
        if wrong:
            raise ValueError(f"every {group} needs exactly {group_rows} rows")
    stored = read_if_present(rows.sparkSession, path, rows.schema)
    fresh = rows
    if stored is not None:
        content = F.sha2(F.to_json(F.struct(*rest)), 256)
        old = stored.select(*keys, content.alias("__old"))
        changed = (
            rows.withColumn("__new", content)
            .join(old, keys)
            .filter(F.col("__new") != F.col("__old"))
            .limit(1)
            .count()
        )
        if changed:
            raise ValueError("immutable rows already exist with different content")
        fresh = rows.join(stored.select(*keys), keys, "left_anti")
    added = fresh.count()
    if added:
        fresh.select(*rows.columns).write.mode("append").parquet(path)
    return added


def write_decisions(rows: DataFrame, path: str, cohort_rows: int = COHORT_ROWS) -> int:
    """Decision rows: a snapshot is written whole, with one row per cohort symbol."""
    return append_immutable(
        rows, path, ["snapshot_id", "symbol"], group="snapshot_id", group_rows=cohort_rows
    )


def write_outcomes(rows: DataFrame, path: str) -> int:
    return append_immutable(rows, path, ["snapshot_id", "symbol"])


def write_once(rows: DataFrame, path: str) -> None:
    """Write a report table; a re-run must produce the same content."""
    stored = read_if_present(rows.sparkSession, path, rows.schema)
    if stored is None:
        rows.write.parquet(path)
        return
    digests = [
        frame.select(F.to_json(F.struct(*rows.columns)).alias("j")) for frame in (rows, stored)
    ]
    new, old = (content_digest(frame, ["j"]).first()["digest"] for frame in digests)
    if new != old:
        raise ValueError("report already exists with different data")


SNAPSHOT_COLUMNS = ["symbol", "security_id", "exchange", "asset_type", "sector", "score", "included", "reason"]


def write_snapshot(rows: DataFrame, root: str, effective_from: str) -> str:
    """Append a universe snapshot under its content-derived id."""
    digest = content_digest(rows, SNAPSHOT_COLUMNS).first()["digest"]
    universe_id = f"US-{effective_from[:7]}-{digest[:12]}"
    (
        rows.select(*SNAPSHOT_COLUMNS)
        .withColumns(
            {
                "universe_id": F.lit(universe_id),
                "effective_from": F.lit(effective_from).cast("date"),
                "checksum": F.lit(digest),
            }
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("universe_id")
        .parquet(root)
    )
    return universe_id


def read_snapshots(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows, and one header per snapshot with whether its content still matches."""
    rows = spark.read.parquet(root)
    digests = content_digest(rows, SNAPSHOT_COLUMNS, by=["universe_id"]).select(
        "universe_id", "digest", "rows"
    )
    declared = rows.groupBy("universe_id").agg(
        F.max("checksum").alias("checksum"), F.max("effective_from").alias("effective_from")
    )
    headers = declared.join(digests, "universe_id").withColumn(
        "valid", F.col("digest") == F.col("checksum")
    )
    return rows, headers


def manifest_union(batches: DataFrame) -> DataFrame:
    """Distinct symbols per date and provider over all batches."""
    return batches.groupBy("as_of", "provider", "symbol").agg(F.min("batch").alias("first_batch"))


def month_rows(spark: SparkSession, path: str, month: str, payload_schema: str) -> DataFrame:
    """One month of stored JSON payloads as columns (month partition pruned)."""
    rows = spark.read.parquet(path).filter(F.col("month") == month)
    return rows.select(
        "snapshot_id", "symbol", "month", F.from_json("payload", payload_schema).alias("p")
    ).select("snapshot_id", "symbol", "month", "p.*")


def record_collection(spark: SparkSession, path: str, run: dict[str, object]) -> None:
    """Append one collection-run row: run_at, record_count, errors, versions."""
    schema = "run_at timestamp, record_count long, errors array<string>, versions map<string,string>"
    spark.createDataFrame([run], schema).write.mode("append").parquet(path)


def archive_schedules(schedules: DataFrame, path: str) -> None:
    """Keep the first archived schedule of a session."""
    append_absent(schedules, path, ["session"])


def upsert_context(prepared: DataFrame, root: str, *, buckets: int = BUCKETS) -> None:
    """Merge a batch of records into the context tables; only the batch's buckets are written.

    The merge rules do not depend on arrival order and may be applied to their own results, so
    any split into batches gives the same tables.
    """
    from tidemark.operators.context import CONTENT_KEY, merge_associations, merge_content

    columns = [name for name in merge_content(prepared).columns]
    upsert(prepared.select(*columns), f"{root}/content", CONTENT_KEY, merge_content, buckets=buckets)

    def merge(rows: DataFrame) -> DataFrame:
        return merge_associations(rows.withColumn("symbols", F.array("symbol")))

    news = merge_associations(prepared)
    upsert(news, f"{root}/associations", CONTENT_KEY, merge, buckets=buckets)


def read_context(spark: SparkSession, root: str, content, associations) -> tuple[DataFrame, DataFrame]:
    """The newest content and associations, given their schemas."""
    return read_buckets(spark, f"{root}/content", content), read_buckets(spark, f"{root}/associations", associations)

"""File and row-set integrity against a declared manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.universe import content_digest


def stored_digests(table: DataFrame, columns: Sequence[str], name: str | None = None) -> DataFrame:
    """Row count and content digest per data file of a file-backed table.

    Rows are hashed where they are read and combined per file; no file is loaded whole. With a
    `name`, the table is one entry of that name, whatever number of files holds it.
    """
    if name is not None:
        files = table.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        total = files.groupBy("path").agg(F.max("bytes").alias("bytes")).agg(F.sum("bytes"))
        digest = content_digest(table.select(*columns), columns)
        return digest.withColumns({"file": F.lit(name), "bytes": total.scalar()})
    located = table.select(
        *columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("bytes")
    )
    sizes = located.groupBy("file").agg(F.max("bytes").alias("bytes"))
    return content_digest(located, columns, by=["file"]).join(sizes, "file")


def audit_files(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Status of every declared or stored file.

    `manifest` and `stored`: file, digest. Paths that leave the root are unsafe.
    """
    declared = manifest.select("file", F.col("digest").alias("declared_digest"))
    present = stored.select("file", F.col("digest").alias("stored_digest"))
    unsafe = F.col("file").startswith("/") | F.col("file").rlike(r"(^|/)\.\.(/|$)")
    return declared.join(present, "file", "full_outer").withColumn(
        "status",
        F.when(unsafe, "unsafe path")
        .when(F.col("stored_digest").isNull(), "missing")
        .when(F.col("declared_digest").isNull(), "undeclared")
        .when(F.col("declared_digest") != F.col("stored_digest"), "checksum mismatch")
        .otherwise("ok"),
    )


def series_fingerprint(bars: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Digest, count and final close of each bar series; repeated starts are counted."""
    values = ["start", "open", "high", "low", "close", "volume"]
    digest = content_digest(bars, values, by=keys)
    tail = bars.groupBy(*keys).agg(F.max_by("close", "start").alias("final_close"))
    repeated = (
        bars.groupBy(*keys, "start")
        .agg(F.count("*").alias("n"))
        .groupBy(*keys)
        .agg(F.count_if(F.col("n") > 1).alias("repeated_starts"))
    )
    return digest.join(tail, list(keys)).join(repeated, list(keys))


def collection_summary(requested: DataFrame, quotes: DataFrame, minimum: int = 30) -> DataFrame:
    """Requested, stored, valid and failed symbols of a collection run, and the pass rule."""
    seen = quotes.groupBy("symbol").agg(
        F.bool_or("is_trade_eligible").alias("__valid"), F.max("latency_ms").alias("__latency")
    )
    joined = requested.select("symbol").distinct().join(seen, "symbol", "left")
    failed = F.count_if(F.col("__valid").isNull())
    valid = F.count_if(F.coalesce("__valid", F.lit(False)))
    return joined.agg(
        F.count("*").alias("requested"),
        F.count("__valid").alias("stored"),
        valid.alias("valid"),
        failed.alias("failed"),
        F.max("__latency").alias("max_latency_ms"),
        ((valid >= minimum) & (failed == 0)).alias("passed"),
    )

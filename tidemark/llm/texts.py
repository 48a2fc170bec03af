"""Helpers of the text operators: columns as bytes for Python tasks, documents by id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import ship_package

#: Rows in an Arrow batch, so that batches of very long texts stay within a worker's memory.
BATCH_ROWS = 500


def raw(name: str) -> Column:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


def map_batches(
    df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """`mapInArrow` with bounded batches and this package on the workers."""
    spark: SparkSession = df.sparkSession
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `rows`, for work on short values that pays per batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(each.num_rows for each in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def bucket_of(name: str, modulus: int) -> Column:
    """crc32 of a value as text, modulo `modulus`; null counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))

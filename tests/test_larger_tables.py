"""Queries against their SQL on tables that the small folders do not show: many files, dense and repeated times."""

import os
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracles import difference  # noqa: E402

from tidemark.plans import candidates  # noqa: E402
from tidemark.registry import ORACLES, QUERIES  # noqa: E402


def compare(spark, folder, name, table, files):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{files}')")
    return difference(QUERIES[name](spark, str(folder)), con, ORACLES[name])


def test_a_table_of_many_files_and_nulls_is_one_entry(spark, tmp_path):
    rows = [(1, "en", "web", 3, "one"), (2, None, "web", None, None), (3, "", None, 0, ""), (4, "de", "x", 1, "|~|")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, n_chars long, text string")
    docs.repartition(3, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert compare(spark, tmp_path, "file_audit", "documents", f"{tmp_path}/documents.parquet/*.parquet") is None
    statuses = {row.file: row.status for row in QUERIES["file_audit"](spark, str(tmp_path)).collect()}
    assert statuses["documents.parquet"] == "checksum mismatch" and len(statuses) == 3


@pytest.mark.parametrize("copies", [1, 3])
def test_candidates_by_source_time_and_features(spark, tmp_path, copies):
    start = "TIMESTAMP_NTZ'2024-01-03 14:29:55'"
    # One symbol trades every 10 seconds, one stops early, one has a gap, one has broken prices.
    kinds = F.expr("stack(4, 'a', 10, 60, 'b', 70, 5, 'c', 10, 60, 'd', 61, 8) AS (event_type, step, many)")
    base = spark.range(60).select("id", kinds).where("id < many").where("NOT (event_type = 'c' AND id BETWEEN 7 AND 12)")
    events = base.crossJoin(spark.range(copies).withColumnRenamed("id", "copy")).select(
        (F.col("id") * 28 + F.ascii("event_type") + F.col("copy") * 100_000).alias("event_id"),
        F.expr(f"timestampadd(SECOND, CAST(id * step AS INT), {start})").alias("ts"),
        F.lit(1).cast("long").alias("user_id"),
        "event_type",
        F.expr("CASE WHEN event_type = 'd' AND id < 5 THEN -5000.0D ELSE CAST(id + copy AS DOUBLE) END").alias("value"),
        F.lit('{"k": 1}').alias("props"),
    )
    events.repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    assert compare(spark, tmp_path, "decision_candidates", "events", f"{tmp_path}/events.parquet/*.parquet") is None
    reasons = {row.symbol: row.reason for row in QUERIES["decision_candidates"](spark, str(tmp_path)).collect()}
    assert reasons["a"] is None and candidates.FEATURES_MISSING in reasons.values() and candidates.OPENING_GAP in reasons.values(), reasons

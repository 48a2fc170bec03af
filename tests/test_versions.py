"""Upserts by bucket and inserts of absent keys: one version at a time, few folders opened."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import context
from tidemark.registry.evidence import _prepared
from tidemark.sources import tables, versions

SCHEMA = "k string, t long, v long"


def newest(rows):
    return rows.groupBy("k").agg(F.max_by(F.struct("t", "v"), F.struct("t", "v")).alias("r")).select("k", "r.*")


def stored(spark, root):
    return sorted(map(tuple, versions.read_buckets(spark, root, SCHEMA).collect()))


def test_batches_give_what_one_gives_and_touch_their_buckets_only(spark, tmp_path):
    rows = [(f"k{i * 7 % 23}", i, i * i) for i in range(60)]
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    versions.upsert(spark.createDataFrame(rows, SCHEMA), one, ["k"], newest, buckets=8)
    for first in range(0, 60, 20):
        versions.upsert(spark.createDataFrame(rows[first : first + 20][::-1], SCHEMA), two, ["k"], newest, buckets=8)
    assert stored(spark, one) == stored(spark, two) and len(stored(spark, one)) == 23
    before = {each["bucket"]: each["folder"] for each in versions.Manifests(spark, two).newest()[1]}
    touched = versions.upsert(spark.createDataFrame([("k1", 99, 1)], SCHEMA), two, ["k"], newest, buckets=8)
    after = {each["bucket"]: each["folder"] for each in versions.Manifests(spark, two).newest()[1]}
    assert len(touched) == 1 and {b for b in after if after[b] != before.get(b)} == set(touched)
    assert ("k1", 99, 1) in stored(spark, two)
    assert versions.upsert(spark.createDataFrame([], SCHEMA), two, ["k"], newest, buckets=8) == []
    with pytest.raises(ValueError):
        versions.upsert(spark.createDataFrame(rows, SCHEMA), two, ["k"], newest, buckets=9)


def test_a_run_killed_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    versions.upsert(spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], SCHEMA), root, ["k"], newest)
    want = stored(spark, root)

    def killed(self, number, entries):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(versions.Manifests, "commit", killed)
        with pytest.raises(KeyboardInterrupt):
            versions.upsert(spark.createDataFrame([("a", 9, 9)], SCHEMA), root, ["k"], newest)
    assert stored(spark, root) == want
    assert len(versions.Manifests(spark, root).orphans()) == 1
    # Half a manifest does not count either, and the next run takes its place.
    (tmp_path / "t" / "manifests" / "000000000002.json").write_text('{"bucket": 1')
    assert stored(spark, root) == want
    versions.upsert(spark.createDataFrame([("a", 9, 9)], SCHEMA), root, ["k"], newest)
    assert stored(spark, root) == [("a", 9, 9), ("b", 1, 1)]
    versions.vacuum(spark, root)
    assert stored(spark, root) == [("a", 9, 9), ("b", 1, 1)] and not versions.Manifests(spark, root).orphans()
    # A second writer of the same version fails.
    number, entries = versions.Manifests(spark, root).newest()
    with pytest.raises(Exception, match="exist"):
        versions.Manifests(spark, root).commit(number - 1, entries)


def test_context_in_three_batches(spark, sf_dir, tmp_path):
    prepared = _prepared(spark, sf_dir)
    for part in range(3):
        tables.upsert_context(prepared.filter(F.pmod(F.xxhash64("external_id", "title"), F.lit(3)) == part), str(tmp_path), buckets=4)
    content, links = context.merge_content(prepared), context.merge_associations(prepared)
    got = tables.read_context(spark, str(tmp_path), content.schema, links.schema)
    for have, want in zip(got, (content, links)):
        assert have.count() == want.count() and have.exceptAll(want).count() == 0


def test_absent_keys_open_few_folders(spark, tmp_path):
    root = str(tmp_path / "q")
    rows = lambda first, last, v=0: spark.range(first, last).select(
        F.concat(F.lit("s"), F.col("id") % 5).alias("symbol"), F.timestamp_micros(F.col("id") * 1_000_000).alias("at"), (F.col("id") * 0 + v).alias("v")
    )
    put = lambda df: versions.insert_absent(df, root, ["symbol", "at"], ["v"], along="at")
    for part in range(4):
        report = put(rows(part * 1000, part * 1000 + 1000))
        assert report == {"added": 1000, "folders": part, "in_range": 0, "opened": 0}
    # Repeats of the third folder: the others are not opened, and nothing changes.
    assert put(rows(2100, 2200, 7)) == {"added": 0, "folders": 4, "in_range": 1, "opened": 1}
    # Over all ranges, but other keys: the filters keep almost all folders shut.
    others = rows(0, 4000).withColumn("symbol", F.lit("new")).filter("unix_micros(at) % 500000000 = 0")
    report = put(others)
    assert report["added"] == 8 and report["in_range"] == 4 and report["opened"] <= 1
    mixed = rows(3990, 4010, 5).unionByName(rows(3990, 4010, 4))
    assert put(mixed)["added"] == 10
    table = versions.read_inserted(spark, root, rows(0, 1).schema)
    assert table.count() == 4018 and table.filter("v = 4").count() == 10 and table.filter("v > 4").count() == 0
    nulls = spark.createDataFrame([("s1", None, 1), (None, None, 2), ("s1", None, 0)], table.schema)
    assert put(nulls)["added"] == 2 and put(nulls)["added"] == 0
    assert versions.read_inserted(spark, root, table.schema).filter("at IS NULL AND symbol = 's1'").first().v == 0
    assert put(rows(0, 0))["added"] == 0 and os.listdir(tmp_path / "q" / "marks")

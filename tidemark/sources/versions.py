"""Tables of immutable files under manifests: upserts by bucket, inserts of absent keys by range and bits.

A write adds folders and, as its last act, a manifest that lists the folders of the new version.
Readers take the newest complete manifest, so they see one version, whole; a run that dies earlier
leaves folders that no manifest names (`orphans` lists them). A manifest is created only where none
of its number exists and ends with a line of its own, so one of two writers fails and half a
manifest does not count.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shared import drop_folder, materialise, scratch

BUCKETS = 64
#: Bits a key has in the filter of its folder, and how many of them are its own.
BITS_PER_KEY = 32
PROBES = 4
#: Positions in one stored piece of a filter (fixed by Spark's bitmap functions).
PIECE = 32_768


class Manifests:
    """The versions of one table below `root`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        java = spark._jvm.org.apache.hadoop.fs
        self._path = java.Path
        self.folder = self._path(f"{self.root}/manifests")
        self.store = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def _read(self, path) -> list[dict] | None:
        stream = self.store.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()
        *lines, last = text.split("\n")
        return [json.loads(line) for line in lines] if last == "end" else None

    def newest(self) -> tuple[int, list[dict]]:
        """The number and the entries of the newest complete version; 0 and none without one."""
        if not self.store.exists(self.folder):
            return 0, []
        found = sorted((each.getPath() for each in self.store.listStatus(self.folder)), key=lambda path: path.getName(), reverse=True)
        for path in found:
            if path.getName().endswith(".json"):
                entries = self._read(path)
                if entries is not None:
                    return int(path.getName().removesuffix(".json")), entries
        return 0, []

    def commit(self, number: int, entries: list[dict]) -> None:
        """Make `entries` the version after `number`; fails where another writer was faster."""
        text = "\n".join([*[json.dumps(entry, sort_keys=True) for entry in entries], "end"])
        path = self._path(self.folder, f"{number + 1:012d}.json")
        if self.store.exists(path) and self._read(path) is None:
            self.store.delete(path, False)  # half a manifest of a run that died
        stream = self.store.create(path, False)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()

    def orphans(self) -> list[str]:
        """Data folders that the newest version does not use."""
        data = self._path(f"{self.root}/data")
        if not self.store.exists(data):
            return []
        used = {entry["folder"] for entry in self.newest()[1]}
        return sorted(name for name in (each.getPath().getName() for each in self.store.listStatus(data)) if name not in used)


# ---- upsert by bucket -----------------------------------------------------------------


def _bucket(key: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def read_buckets(spark: SparkSession, root: str, schema, only: Sequence[int] | None = None) -> DataFrame:
    """The newest version of an upserted table, or some of its buckets."""
    entries = Manifests(spark, root).newest()[1]
    paths = [f"{root}/data/{each['folder']}/bucket={each['bucket']}" for each in entries if only is None or each["bucket"] in only]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def upsert(
    batch: DataFrame, root: str, key: Sequence[str], merge: Callable[[DataFrame], DataFrame], *, buckets: int = BUCKETS
) -> list[int]:
    """Merge a batch into the table at `root`; returns the buckets that were written anew.

    `merge` reduces rows of equal key and must give the same from stored and new rows as from all
    rows at once. Keys are dealt to buckets by hash; only the batch's buckets are read and written.
    """
    spark = batch.sparkSession
    manifests = Manifests(spark, root)
    number, entries = manifests.newest()
    if entries and entries[0]["of"] != buckets:
        raise ValueError(f"the table has {entries[0]['of']} buckets")
    with scratch(spark):
        # Reduced before it is looked at twice; a copied item costs one row per task.
        batch = materialise(merge(batch))
        # At most as many rows as there are buckets.
        touched = sorted(row.b for row in batch.select(_bucket(key, buckets).alias("b")).distinct().collect())
        if not touched:
            return []
        stored = read_buckets(spark, root, batch.schema, touched)
        merged = merge(stored.unionByName(batch)).withColumn("bucket", _bucket(key, buckets))
        folder = uuid.uuid4().hex
        merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{root}/data/{folder}")
    kept = [each for each in entries if each["bucket"] not in touched]
    new = [{"bucket": bucket, "folder": folder, "of": buckets} for bucket in touched]
    manifests.commit(number, sorted([*kept, *new], key=lambda each: each["bucket"]))
    return touched


# ---- insert of absent keys ------------------------------------------------------------


def _positions(keys: Sequence[str], slots: int) -> Column:
    """The bits of a key in a filter of `slots` bits."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(i), *keys), F.lit(slots)) for i in range(PROBES)])


def _marks(rows: DataFrame, keys: Sequence[str], slots: int) -> DataFrame:
    """A filter over the keys of `rows`: pieces of PIECE bits, those without a bit left out."""
    at = rows.select(F.explode(_positions(keys, slots)).alias("at"))
    piece, bit = F.floor(F.col("at") / PIECE), F.pmod(F.col("at"), F.lit(PIECE))
    return at.groupBy(piece.alias("piece")).agg(F.bitmap_construct_agg(bit).alias("bits"))


def _may_hold(batch: DataFrame, keys: Sequence[str], marks: DataFrame, slots: int) -> DataFrame:
    """The folders whose filters have all bits of some key of `batch`."""
    row = F.struct(*keys)
    asked = batch.select(row.alias("key"), F.explode(_positions(keys, slots)).alias("at")).withColumn("piece", F.floor(F.col("at") / PIECE))
    bit = F.pmod(F.col("at"), F.lit(PIECE)).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(pmod(at, 32768) DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    isset = F.getbit(byte, F.pmod(bit, F.lit(8))) == 1
    hit = asked.join(marks, "piece").where(isset)
    # Two positions of a key may be the same one, so distinct ones are counted on both sides.
    found = hit.groupBy("folder", "key").agg(F.count_distinct("at").alias("n"))
    needed = F.size(F.array_distinct(_positions([f"key.{name}" for name in keys], slots)))
    return found.where(F.col("n") == needed).select("folder").distinct()


def read_inserted(spark: SparkSession, root: str, schema) -> DataFrame:
    """The newest version of a table that `insert_absent` writes."""
    paths = [f"{root}/data/{each['folder']}" for each in Manifests(spark, root).newest()[1]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def insert_absent(
    rows: DataFrame, root: str, keys: Sequence[str], order: Sequence[str] = (), *, along: str
) -> dict[str, int]:
    """Insert the rows whose key is not stored yet; of a batch's rows of one key the first stays.

    `along` is the key's column that grows as data comes in. Each insert is one folder with the
    range of `along` and a filter over its keys. A batch opens only folders whose range it meets and
    whose filter has all bits of one of its keys, and of those only the key columns. Returns how many
    rows were added, and how many folders there were, met the range and were opened.
    """
    spark, keys = rows.sparkSession, list(keys)
    manifests = Manifests(spark, root)
    number, entries = manifests.newest()
    rest = [name for name in rows.columns if name not in keys]
    first = F.min(F.struct(*order, *[name for name in rest if name not in order])).alias("__r")
    # Times are compared as microseconds, other columns as whole numbers.
    place = F.unix_micros(F.col(along)) if dict(rows.dtypes)[along] == "timestamp" else F.col(along).cast("long")
    with scratch(spark):
        batch = materialise(rows.groupBy(*keys).agg(first).select(*[F.col(n) if n in keys else F.col("__r").getField(n).alias(n) for n in rows.columns]))
        span = batch.agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"), F.count_if(place.isNull()).alias("nulls")).first()
        report = {"added": 0, "folders": len(entries), "in_range": 0, "opened": 0}
        if not span.n:
            return report
        bounded = span.low is not None and not span.nulls
        near = [e for e in entries if not bounded or e["low"] is None or (e["low"] <= span.high and e["high"] >= span.low)]
        report["in_range"] = len(near)
        opened: set[str] = set()
        for slots in sorted({each["slots"] for each in near}):  # powers of two: few
            names = [each["folder"] for each in near if each["slots"] == slots]
            marks = spark.read.parquet(*[f"{root}/marks/{name}" for name in names])
            marks = marks.withColumn("folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
            opened |= {row.folder for row in _may_hold(batch, keys, marks, slots).collect()}
        report["opened"] = len(opened)
        fresh = batch
        if opened:
            stored = spark.read.schema(rows.schema).parquet(*[f"{root}/data/{name}" for name in sorted(opened)]).select(*[F.col(k).alias(f"__{k}") for k in keys])
            same = F.lit(True)
            for k in keys:
                same = same & batch[k].eqNullSafe(stored[f"__{k}"])
            fresh = materialise(batch.join(stored, same, "left_anti"))
        new = fresh.agg(F.count("*").alias("n"), F.min(place).alias("low"), F.max(place).alias("high"), F.count_if(place.isNull()).alias("nulls")).first()
        if not new.n:
            return report
        folder = uuid.uuid4().hex
        slots = 1 << max(15, (new.n * BITS_PER_KEY - 1).bit_length())
        fresh.write.parquet(f"{root}/data/{folder}")
        _marks(fresh, keys, slots).write.parquet(f"{root}/marks/{folder}")
    known = not new.nulls
    entry = {"folder": folder, "rows": new.n, "low": new.low if known else None, "high": new.high if known else None, "slots": slots}
    manifests.commit(number, [*entries, entry])
    return report | {"added": new.n}


def vacuum(spark: SparkSession, root: str) -> list[str]:
    """Delete the data folders that the newest version does not use; no reader may be at an older one."""
    gone = Manifests(spark, root).orphans()
    for name in gone:
        drop_folder(spark, f"{root}/data/{name}")
        drop_folder(spark, f"{root}/marks/{name}")
    return gone

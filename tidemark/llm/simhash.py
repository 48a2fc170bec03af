"""Near duplicates by 64-bit SimHash and anchor-point covering.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's word shingles.
Two fingerprints that differ in at most 3 bits differ in at most 1 bit in one of their 32-bit
halves, so each half is searched for distance 1:

* Anchors of a half are the code words of the Hamming (31, 26) code next to one free bit.
  Every half is within distance 1 of exactly one anchor, its home (covering radius 1).
* Each fingerprint is replicated to every anchor within covering radius plus threshold, that
  is to the home of each half at distance 0 or 1: at most 17 per half, over 2^27 anchors.
* Fingerprints at one anchor are compared with those whose home it is.

Equal fingerprints are one class before any of this, so copies never meet each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.texts import map_batches, raw
from tidemark.shared import materialise

HALF = 32
#: Shingles whose bits are counted at once, so that a very long text needs little memory.
RUN = 65_536


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a text's `width`-word shingles, repeats included; no words give 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, len(shingles), RUN):
        hashes = np.array([digest(each, 42) for each in shingles[start : start + RUN]], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big", signed=True)


def of_hashes(hashes: np.ndarray) -> int:
    """SimHash of unsigned 64-bit shingle hashes as a signed long; none give 0."""
    counts = np.zeros(64, np.int64)
    for start in range(0, len(hashes), RUN):
        run = hashes[start : start + RUN].astype(">u8")
        counts += np.unpackbits(run.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, width: int = 3) -> DataFrame:
    """Rows (doc_id, text_key, fp): fp is the fingerprint as a signed long.

    Null text has no words. Every input row gives a row, repeated ones too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(value.as_py(), width) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints, pa.int64())], ["doc_id", "text_key", "fp"]
            )

    narrow = df.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), raw("text"))
    return map_batches(narrow, run, "doc_id long, text_key long, fp long")


def _syndrome(half: Column) -> Column:
    """Hamming syndrome of bits 1..31 (bit 0 is free): the xor of the positions that are set."""
    # Bit k of the syndrome is the parity of the positions whose number has bit k.
    masks = [sum(1 << place for place in range(1, HALF) if place >> k & 1) for k in range(5)]
    out = F.lit(0).cast("long")
    for k, mask in enumerate(masks):
        parity = F.bit_count(half.bitwiseAND(F.lit(mask).cast("long"))).cast("long") % 2
        out = out + parity * F.lit(1 << k).cast("long")
    return out


def anchors(classes: DataFrame) -> DataFrame:
    """Rows (fp, side, anchor, home) for every anchor within radius 1 + threshold 1 of a half."""
    halves = classes.select(
        "fp",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("side"), F.expr("fp & 4294967295L").alias("half")),
                F.struct(F.lit(1).alias("side"), F.expr("shiftrightunsigned(fp, 32)").alias("half")),
            )
        ),
    )
    known = halves.withColumn("wrong", _syndrome(F.col("half")).cast("int"))
    homed = known.withColumn("nearest", F.expr("IF(wrong = 0, half, half ^ shiftleft(1L, wrong))"))
    # At distance 2 lie the words that undo the syndrome by two bits instead of one; the free
    # bit may differ instead, and then only the nearest word is in reach.
    reached = F.expr(
        """concat(
            array(nearest, nearest ^ 1L),
            transform(
                filter(sequence(1, 31), j -> j < (j ^ wrong)),
                j -> half ^ shiftleft(1L, j) ^ shiftleft(1L, j ^ wrong)))"""
    )
    return homed.select("fp", "side", "nearest", F.explode(reached).alias("anchor")).select(
        "fp", "side", "anchor", (F.col("anchor") == F.col("nearest")).alias("home")
    )


def links(classes: DataFrame, distance: int = 3) -> DataFrame:
    """Edges (a, b) between fingerprints that differ in at most `distance` bits (3 at most).

    Home copies at an anchor meet the copies that were replicated to it; each pair is tested in
    full. The join is on the anchor and Spark splits skewed anchors.
    """
    if not 0 <= distance <= 3:
        raise ValueError("the anchors cover differences of up to 3 bits")
    placed = anchors(classes)
    home = placed.where("home").select("side", "anchor", F.col("fp").alias("a"))
    reach = placed.select("side", "anchor", F.col("fp").alias("b"))
    return (
        reach.join(home, ["side", "anchor"])
        .where(F.col("a") > F.col("b"))
        .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
        .select("a", "b")
    )


def near_duplicates(df: DataFrame, distance: int = 3) -> DataFrame:
    """Rows (doc_id, text_key, fp, component_id) for every row of `df(doc_id, text)`.

    component_id is the smallest doc_id that is reachable over links of at most `distance`
    bits, itself included. Rows whose component has no id at all get null. An empty table gives
    an empty table; columns besides doc_id and text are not read.
    """
    prints = materialise(fingerprints(df))
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    grouped = components(links(classes, distance))
    # Only linked classes have a component; a class alone keeps its own smallest id.
    linked = grouped.join(classes, grouped["node"] == classes["fp"]).select("fp", "component", "first_id")
    lowest = linked.groupBy("component").agg(F.min("first_id").alias("low"))
    moved = linked.join(lowest, "component").select("fp", "low", F.lit(True).alias("linked"))
    ids = classes.join(moved, "fp", "left").select(
        "fp", F.when(F.col("linked"), F.col("low")).otherwise(F.col("first_id")).alias("component_id")
    )
    # Written, so that both sides of the last join are plain shuffles: Spark splits only those
    # where one fingerprint has a large share of all rows.
    ids = materialise(ids)
    return prints.join(ids, "fp").select("doc_id", "text_key", "fp", "component_id")


def result(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id of whole texts."""
    return near_duplicates(df).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def representatives(df: DataFrame, distance: int = 3) -> DataFrame:
    """One row of `df` per component, with all its columns: the smallest doc_id's, ties by text.

    Rows without an id count only where their component has no other.
    """
    grouped = near_duplicates(df.select("doc_id", "text"), distance)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key")).alias("first")
    # A component is named by its smallest id; rows without any id stand for their own text.
    own = F.when(F.col("component_id").isNull(), F.col("fp"))
    chosen = grouped.groupBy("component_id", own.alias("own")).agg(first).select("first.doc_id", "first.text_key")
    chosen = materialise(chosen.distinct())  # a plain side, as above
    keyed = df.select(F.struct(*df.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    same = keyed["text_key"].eqNullSafe(chosen["text_key"]) & keyed["doc_id"].eqNullSafe(chosen["doc_id"])
    kept = keyed.join(chosen, same, "left_semi")
    # Rows that repeat both id and text are one document.
    return kept.groupBy("doc_id", "text_key").agg(F.min("row").alias("row")).select("row.*")

"""Benchmark decontamination with one Aho-Corasick automaton.

Test items are normalised to words (A-Z lower-cased; digits, letters and everything beyond
ASCII are word characters) and cut into windows of consecutive words. One automaton holds all
distinct windows. A text is normalised to the same alphabet once, byte for byte, so that places
in the scanned text lead back to the original, and is scanned once.

The benchmark is a parameter of the job, not corpus data: an automaton holds at most
`automaton_bytes` of window text. A larger benchmark is dealt by hash into several automata,
the texts are scanned once for each, and hits are united, with the same result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import map_batches, raw
from tidemark.shared import materialise

WINDOW = 13
AUTOMATON_BYTES = 64 * 1024 * 1024

_LOWER = bytes(
    value + 32 if 65 <= value <= 90 else value if value >= 128 or 48 <= value <= 57 or 97 <= value <= 122 else 32
    for value in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def windows_of(words: list[bytes], width: int) -> set[bytes]:
    """All windows of `width` words; a shorter text that has words is one window."""
    if not words:
        return set()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def build(windows: dict[bytes, list]) -> object:
    """An automaton over ` word word ... word `, so that it matches at word borders only."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for window, items in windows.items():
        key = f" {window.decode('latin-1')} "
        automaton.add_word(key, (len(window.split()), items))
    automaton.make_automaton()
    return automaton


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, with those that overlap or touch made one."""
    out: list[list[int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(start, stop) for start, stop in out]


def scan(automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """Word ranges [start, stop) inside windows, and the items met."""
    line = f" {b' '.join(words).decode('latin-1')} "
    ranges: list[tuple[int, int]] = []
    items: set = set()
    stop = at = 0
    for end, (length, found) in automaton.iter(line):
        stop += line.count(" ", at, end)
        at = end
        items.update(found)
        ranges.append((stop - length, stop))
    return united(ranges), items


def spans_of(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte spans in the original text of word ranges: normalising keeps every offset."""
    if not ranges:
        return []
    places = [found.span() for found in _WORD.finditer(text.translate(_LOWER))]
    return [(places[a][0], places[b - 1][1]) for a, b in ranges]


_BUILT: dict[str, object] = {}


def _automaton(token: str, items: list[tuple[str, bytes]], width: int):
    """The automaton of these items; a worker builds it once and keeps the latest one."""
    if token not in _BUILT:
        windows: dict[bytes, list[str]] = {}
        for item, text in items:
            for window in windows_of(words_of(text), width):
                windows.setdefault(window, []).append(item)
        _BUILT.clear()
        _BUILT[token] = build(windows) if windows else None
    return _BUILT[token]


def _pass(df: DataFrame, items: list[tuple[str, bytes]], width: int) -> DataFrame:
    """One scan: adds hits to `df(row, text, ranges, items)` and sets n_words and spans."""
    sent = df.sparkSession.sparkContext.broadcast(items)
    token = uuid.uuid4().hex
    ranges_type = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(token, sent.value, width)
        for batch in batches:
            counts, ranges, met, spans = [], [], [], []
            for text, before, names in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                data = text.as_py()
                words = words_of(data)
                hit, found = scan(automaton, words) if automaton and words else ([], set())
                hit = united(hit + [(x["start"], x["stop"]) for x in before])
                counts.append(len(words))
                ranges.append(hit)
                met.append(sorted(found | set(names)))
                spans.append(spans_of(data, hit))
            named = lambda rows: pa.array([[{"start": a, "stop": b} for a, b in row] for row in rows], ranges_type)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    named(ranges),
                    pa.array(met, pa.list_(pa.string())),
                    pa.array(counts, pa.int64()),
                    named(spans),
                ],
                ["row", "text", "ranges", "items", "n_words", "spans"],
            )

    pairs = "array<struct<start:bigint,stop:bigint>>"
    schema = f"row {df.schema['row'].dataType.simpleString()}, text binary, ranges {pairs}, items array<string>, n_words bigint, spans {pairs}"
    return map_batches(df.select("row", "text", "ranges", "items"), run, schema)


def judge(
    df: DataFrame,
    benchmark: DataFrame,
    keep: list[str],
    width: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """Every row of `df` as `row` (the columns of `keep`), with what its text shares.

    Adds n_words, ranges (word positions inside windows), spans (the same in bytes of the
    original text), items (ids as text, sorted; a null id is the empty text), n_hit and
    contaminated: some word is hit, and at least one word in twenty. Null and empty texts have
    no words and are clean; items without words match nothing; repeated ids count once.
    """
    tests = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), raw("text"))
    size = tests.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size * width / automaton_bytes))
    state = df.select(
        F.struct(*keep).alias("row"),
        raw("text"),
        F.expr("CAST(array() AS array<struct<start:bigint,stop:bigint>>)").alias("ranges"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    for part in range(parts):
        share = tests if parts == 1 else tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        state = _pass(state, [(x.item_id, bytes(x.text)) for x in share.toLocalIterator()], width)
        if part + 1 < parts:
            state = materialise(state)
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda total, x: total + x.stop - x.start)
    return state.select("row", "n_words", "ranges", "spans", "items", n_hit.alias("n_hit")).withColumn(
        "contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    )


def result(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of `judge` per document."""
    return judge(df, benchmark, ["doc_id"]).select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def clean(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `df` that are not contaminated, with their columns."""
    judged = judge(df, benchmark, df.columns)
    return judged.where(~F.col("contaminated")).select("row.*")

"""Repair of conversations: faults of their rows and the cheapest edits that make roles alternate.

Rows are put in order of (conversation, turn, role, text) by ranges, so that a long conversation is
dealt over as many tasks as it needs. A task reads its rows as a stream and searches each run of one
conversation (`repair_search`). Only the first and the last run of a task may go on in another one:
they yield the cheapest repairs between all states, and these small rows are joined in order. The
digest of a repaired text is made where the run is whole; for the few conversations in several runs
their rows are read once more, as a stream as well.

Which rows repeat an earlier one is found beforehand by grouping digests of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.repair_search import CUT, DOOMED, PART, SOUND, Lines, Message, Paths, cheapest, joined, paths, search
from tidemark.llm.texts import map_batches
from tidemark.shared import materialise

#: Rows of a run whose texts are held until its end; longer runs are digested by a second reading.
HELD_ROWS = 4_096
#: Bytes of text that are held for this, likewise.
HELD_BYTES = 64 << 20
LEGAL = frozenset(("su", "ua", "au"))
#: How much of a text takes part in cutting ranges; rows are then sorted by all of it.
RANGE_CHARS = 32

COUNTS = ["blank", "duplicate", "truncated", "illegal"]
RUNS = (
    "conv_id long, part int, number int, whole boolean, blank long, duplicate long, truncated long, illegal long, "
    "low long, high long, turns long, first_turn long, last_turn long, first_initial string, last_initial string, "
    "cost long, audit string, repaired_sha256 string, paths array<struct<entry:int,goal:int,cost:bigint,edits:string>>"
)
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(df: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) of the damage that the crc32 of `conv_id:turn` picks.

    Nulls count as one space there and in role and text. A dropped row stays with `gone`, empty,
    because its conversation is to be returned.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    pick = F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")), F.lit(20))
    copies = F.when(pick == 3, 2).otherwise(1)
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(pick == 0, "").when(pick == 4, "user").otherwise(text("role")).alias("role"),
        F.when(pick.isin(0, 1), "").when(pick == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text")).alias("text"),
        (pick == 0).alias("gone"),
        F.explode(F.sequence(F.lit(1), copies)).alias("copy"),
    )
    return rows.drop("copy")


def fault_of(repeated: Column) -> Column:
    """A row's first fault: blank, duplicate or truncated; none is null."""
    # The class of characters that are neither a blank nor a control that counts as one.
    last = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    return F.when(last == "", "blank").when(repeated, "duplicate").when(~last.isin(".", "!", "?"), "truncated")


def with_faults(rows: DataFrame) -> DataFrame:
    """`rows` with `fault`, but for repeats within one turn: those stand side by side once sorted."""
    print_ = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    turn = F.struct(F.col("turn").isNotNull().alias("named"), "turn")
    keyed = rows.withColumn("print", print_)
    seen = keyed.where("NOT gone").groupBy("conv_id", "print").agg(F.min(turn).alias("from"), F.max(turn).alias("to"))
    later = seen.where(F.col("from") < F.col("to")).select(F.col("conv_id").alias("conv"), F.col("print").alias("same"), "from")
    both = keyed.join(later, keyed["conv_id"].eqNullSafe(later["conv"]) & (keyed["print"] == later["same"]), "left")
    repeated = F.coalesce(turn > F.col("from"), F.lit(False))
    return both.select("conv_id", "turn", "role", "text", "gone", F.when(~F.col("gone"), fault_of(repeated)).alias("fault"))


class Run:
    """Consecutive rows of one conversation, searched in parts of `part` rows; up to `most` texts are held."""

    def __init__(self, conv_id: int | None, part: int, most: int):
        self.conv_id, self.part, self.most = conv_id, part, most
        self.counts = dict.fromkeys(COUNTS, 0)
        self.turns: list[int | None] = [None, None, None]  # lowest, highest; the last one read
        self.distinct = 0
        self.first: tuple | None = None
        self.before: tuple | None = None
        self.waiting: list[Message] = []
        self.found: Paths | None = None
        self.texts: list[tuple[str, str]] | None = []
        self.held = 0

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if self.before is not None and self.before[:3] == (turn, role, text) and fault != "blank":
            fault = "duplicate"
        if fault is not None:
            self.counts[fault] += 1
        if self.before is None:
            self.first = turn, role[:1]
        elif self.before[1][:1] + role[:1] not in LEGAL:
            self.counts["illegal"] += 1
        if turn is not None:
            low, high, last = self.turns
            self.distinct += turn != last
            self.turns = [turn if low is None else min(low, turn), turn if high is None else max(high, turn), turn]
        self.before = turn, role, text
        if len(self.waiting) == self.part:
            self.settle()
        self.waiting.append((CUT if fault == "truncated" else DOOMED if fault else SOUND, role[:1]))
        if self.texts is not None:
            self.texts.append((role, text))
            self.held += len(text)
            if len(self.texts) > self.most or self.held > HELD_BYTES:
                self.texts = None

    def settle(self) -> None:
        """Searches what is waiting, between all states."""
        self.found = joined(self.found, paths(self.waiting))
        self.waiting = []

    def row(self, part: int, number: int, whole: bool) -> dict:
        """The run's row of RUNS; only a whole run whose texts are held is finished by it."""
        whole = whole and self.texts is not None
        low, high, last = self.turns
        out = {"conv_id": self.conv_id, "part": part, "number": number, "whole": whole, **self.counts}
        out |= {"low": low, "high": high, "turns": self.distinct, "first_turn": None, "last_turn": last}
        out |= {"first_initial": None, "last_initial": None, "cost": None, "audit": None, "repaired_sha256": None, "paths": None}
        if self.first is not None:
            out |= {"first_turn": self.first[0], "first_initial": self.first[1], "last_initial": self.before[1][:1]}
        if whole:
            if self.found is None:
                cost, edits = search(self.waiting)[0]
            else:
                self.settle()
                cost, edits = cheapest(self.found)
            lines = Lines(edits)
            repaired = [line for role, text in self.texts for line in lines.of(role, text)]
            repaired.extend(lines.inserted())
            digest = hashlib.sha256("\n".join(repaired).encode("utf-8", "surrogatepass")).hexdigest()
            out |= {"cost": cost, "audit": edits, "repaired_sha256": digest}
        else:
            if self.waiting or self.found is None:
                self.settle()
            out["paths"] = [{"entry": a, "goal": b, "cost": c, "edits": e} for (a, b), (c, e) in self.found.items()]
        return out


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _typed(schema: str, rows: list[dict]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    path = pa.list_(pa.struct([("entry", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))
    fields = [each.split(" ") for each in schema.split(", ")]
    return pa.RecordBatch.from_arrays(
        [pa.array([row[name] for row in rows], kinds.get(kind, path)) for name, kind in fields], [name for name, _ in fields]
    )


def runs_of(rows: DataFrame, part_rows: int = PART, held_rows: int = HELD_ROWS) -> DataFrame:
    """One row of RUNS for each run of a conversation's rows in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, now, out = TaskContext.get().partitionId(), 0, None, []
        for conv_id, turn, role, text, gone, fault in _records(batches):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    out.append(now.row(part, number, whole=number > 0))
                    number += 1
                    if len(out) >= 500:
                        yield _typed(RUNS, out)
                        out = []
                now = Run(conv_id, part_rows, held_rows)
            if not gone:
                now.add(turn, role, text, fault)
        if now is not None:
            out.append(now.row(part, number, whole=False))
        if out:
            yield _typed(RUNS, out)

    cut = ["conv_id", "turn", F.substring("role", 1, RANGE_CHARS), F.substring("text", 1, RANGE_CHARS)]
    ordered = rows.repartitionByRange(*cut).sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(ordered, run, RUNS)


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else high - low + 1 - turns


def together(runs: DataFrame) -> DataFrame:
    """Rows of RESULT without digests: the runs of each conversation joined in order.

    A conversation has as many runs as tasks, and its runs' edits are as long as its result.
    """

    def finished(held: dict) -> dict:
        cost, edits = cheapest(held["found"])
        gaps = _gaps(held["low"], held["high"], held["turns"])
        return {**{k: held[k] for k in ("conv_id", *COUNTS)}, "gaps": gaps, "cost": cost, "audit": edits, "repaired_sha256": None}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None
        for batch in batches:
            for row in batch.to_pylist():
                found = {(x["entry"], x["goal"]): (x["cost"], x["edits"]) for x in row["paths"]}
                if held is None or held["conv_id"] != row["conv_id"]:
                    if held is not None:
                        yield _typed(RESULT, [finished(held)])
                    held = row | {"found": found}
                    continue
                held["found"] = joined(held["found"], found)
                for name in COUNTS:
                    held[name] += row[name]
                if row["first_initial"] is None:  # all of its rows are gone
                    continue
                if held["last_initial"] is not None and held["last_initial"] + row["first_initial"] not in LEGAL:
                    held["illegal"] += 1
                shared = row["first_turn"] is not None and row["first_turn"] == held["last_turn"]
                held["turns"] += row["turns"] - shared
                held["last_initial"] = row["last_initial"]
                if row["low"] is not None:
                    held["low"] = row["low"] if held["low"] is None else held["low"]
                    held["high"], held["last_turn"] = row["high"], row["last_turn"]
        if held is not None:
            yield _typed(RESULT, [finished(held)])

    return map_batches(runs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number"), run, RESULT)


def digested(results: DataFrame, rows: DataFrame) -> DataFrame:
    """`results` with the digests of their repaired texts, by a stream over their rows."""
    names = [each.split(" ")[0] for each in RESULT.split(", ")]
    wanted = results.select(F.col("conv_id").alias("wanted"))
    mine = rows.join(wanted, rows["conv_id"].eqNullSafe(wanted["wanted"]), "left_semi").where("NOT gone")
    first = results.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.struct(*names).alias("result"))
    rest = mine.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", F.lit(None).cast(first.schema["result"].dataType).alias("result"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines, digest, some = None, None, None, False

        def feed(each: Iterator[str]) -> None:
            nonlocal some
            for line in each:
                digest.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
                some = True

        def finished() -> pa.RecordBatch:
            feed(lines.inserted())
            return _typed(RESULT, [held | {"repaired_sha256": digest.hexdigest()}])

        for _, kind, _, role, text, result in _records(batches):
            if kind == 0:
                if held is not None:
                    yield finished()
                held, lines, digest, some = result, Lines(result["audit"]), hashlib.sha256(), False
            else:
                feed(lines.of(role, text))
        if held is not None:
            yield finished()

    stream = first.unionByName(rest).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    return map_batches(stream, run, RESULT)


def repaired(rows: DataFrame, part_rows: int = PART, held_rows: int = HELD_ROWS) -> DataFrame:
    """One row of RESULT per conversation of `rows(conv_id, turn, role, text, gone)`.

    Rows of one turn stand in order of role and text. A role without any character has no legal
    initial. A conversation without rows has zeros, no edits and the digest of the empty text.
    """
    runs = materialise(runs_of(with_faults(rows), part_rows, held_rows))
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    names = [each.split(" ")[0] for each in RESULT.split(", ")]
    whole = runs.where("whole").select(*[gaps if name == "gaps" else name for name in names])
    parts = materialise(together(runs.where("NOT whole")))
    return whole.unionByName(digested(parts, rows))


def result(df: DataFrame) -> DataFrame:
    """The damaged rows of `df(conv_id, turn, role, text)` repaired: one row per original conv_id.

    Null ids are one conversation, null turns come first, null roles and texts are one space.
    Repeated rows are duplicates. An empty table gives an empty table.
    """
    return repaired(damaged(df))

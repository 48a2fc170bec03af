"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

N(g) is the number of open sequences that have room for g more tokens. A piece of s tokens goes
where the sum of N(g)^2 over all g becomes smallest: into a sequence of room g it changes the sum
by 2 N(g - s) - 2 N(g) + 2, or by 1 - 2 N(s) where it fills the sequence, which then is closed.
Ties go to the tightest room. Two rules keep the number of sequences down: pieces come in order of
falling length, and a new sequence is opened only when no open one has room (the plain rule opens
one as soon as that is cheaper, which leaves many sequences half empty at the end).

Documents are tokenised first and written as one short row per piece. Packing then reads these
rows by file split, in windows of at most WINDOW_PIECES, so no key decides who packs what and a
window's work and memory are bounded. Each window leaves a few sequences that are not full.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import map_batches, raw
from tidemark.llm.word_pieces import word_encoder
from tidemark.shared import materialise

ROOM = 4_096
END_ID = (1).to_bytes(4, "little")
#: Pieces that are packed together, at most.
WINDOW_PIECES = 1_000_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = f"{PIECES}, sequence_id long, offset long"


def squares(lengths: np.ndarray, room: int = ROOM) -> tuple[np.ndarray, np.ndarray, int]:
    """The sequence and the offset of each piece of 1 to `room` tokens, and the number of sequences."""
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    full = lengths == room
    used = int(full.sum())
    sequence[full] = np.arange(used)
    # before[g] is N(g) of the room that is left; before[0] stands for a closed sequence, whose
    # cost is half a step lower. after[g] is N(g), or never where there is none to fill.
    never = -1e18
    before = np.zeros(room + 1)
    before[0] = -0.5
    after = np.full(room + 1, never)
    open_at: list[list[int]] = [[] for _ in range(room + 1)]
    rest = np.flatnonzero(~full)
    order = rest[np.argsort(-lengths[rest], kind="stable")]
    widest = 0  # no open sequence has more room
    for at, size in zip(order.tolist(), lengths[order].tolist()):
        while widest and not open_at[widest]:
            widest -= 1
        if widest < size:
            gap, chosen = room, used
            used += 1
        else:
            gap = size + int((before[: widest + 1 - size] - after[size : widest + 1]).argmin())
            chosen = open_at[gap].pop()
            left = len(open_at[gap])
            before[gap] = left
            after[gap] = left or never
        sequence[at] = chosen
        offset[at] = room - gap
        gap -= size
        if gap:
            open_at[gap].append(chosen)
            before[gap] = after[gap] = len(open_at[gap])
            widest = max(widest, gap)
    return sequence, offset, used


def pieces(df: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): every text's ids and the end id, cut at `room`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_encoder(path).encode
        for batch in batches:
            out = defaultdict(list)
            texts = [value.as_py().decode("utf-8", "replace") for value in batch.column(1)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(texts)):
                ids += END_ID
                for number, first in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[first : first + 4 * room]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(number)
                    out["start"].append(first // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out.values(), types)], list(out))

    return map_batches(df.select(F.col("doc_id").cast("long"), raw("text")), run, PIECES)


def placed(df: DataFrame, room: int = ROOM) -> DataFrame:
    """The pieces of `df`, a stored table, with sequence_id and offset.

    A lost task reads the same split again and packs it the same way.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33

        def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal first
            window = pa.Table.from_batches(held)
            sequence, offset, used = squares(window.column("length").to_numpy(), room)
            window = window.append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
            first += used
            return window

        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if held and count + batch.num_rows > WINDOW_PIECES:
                yield from pack(held).to_batches()
                held, count = [], 0
            held.append(batch)
            count += batch.num_rows
        if held:
            yield from pack(held).to_batches()

    return map_batches(df, run, PLACED)


def result(df: DataFrame, path: str, room: int = ROOM) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset) for all of `df(doc_id, text)`.

    Null and empty texts have the end id alone. Rows without an id or with a repeated one are
    documents of their own. Longer documents are cut into pieces of `room` tokens, the last one
    may be shorter; nothing else is cut. An empty table gives an empty table.
    """
    return placed(materialise(pieces(df, path, room)), room)

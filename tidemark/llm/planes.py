"""Token-id files: blocks of ids as bit planes, each compressed, with a chunk index.

A file row is a chunk: whole documents in order, at least CHUNK_IDS ids where there are as
many, one document where it is longer. The ids of a chunk are cut into blocks of BLOCK_IDS;
a block is transposed, so that plane k holds bit k of all its ids, and each plane that has a
bit set is compressed with zstandard. High planes of small ids are empty or nearly so.

A chunk's bytes: magic, number of ids, block size; per block the mask of its planes and each
plane's length; then the planes. The index beside it (documents, their lengths, first id) lets
a reader find documents without touching other chunks.

Files are written by Spark's own Parquet writer in the shared folder, one per range of document
ids, so a lost task is written anew and never seen half done.
"""

from __future__ import annotations

import os
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import map_batches, raw
from tidemark.shared import shared_folder

MAGIC = b"IDP1"
BLOCK_IDS = 8_192
CHUNK_IDS = 262_144
END_ID = (0).to_bytes(4, "little")
#: Marks that are a piece of their own, or part of one, after a letter or a digit.
CLOSING = ".,;:!?%#*&$"
#: Distinct parts of texts whose ids a worker remembers.
KEPT_PARTS = 1_200_000
#: Parts that are encoded as one line.
LINE_PARTS = 2_000


def pack(ids: np.ndarray, level: int = 1) -> bytes:
    """A chunk of ids below 2^32 as compressed bit planes."""
    ids = np.ascontiguousarray(ids, "<u4")
    press = zstandard.ZstdCompressor(level=level).compress
    heads, bodies = [], []
    for first in range(0, len(ids), BLOCK_IDS):
        block = ids[first : first + BLOCK_IDS]
        used = int(np.bitwise_or.reduce(block))
        # Rows of `bits` are ids, least significant bit first; its columns are the planes.
        rows = block.astype("<u2") if used < 1 << 16 else block
        bits = np.unpackbits(rows.view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
        planes = np.packbits(np.ascontiguousarray(bits.T[: used.bit_length()]), axis=1)
        packed = [press(planes[k].tobytes()) for k in range(used.bit_length()) if used >> k & 1]
        heads.append(struct.pack(f"<I{len(packed)}I", used, *map(len, packed)))
        bodies += packed
    return MAGIC + struct.pack("<QI", len(ids), BLOCK_IDS) + b"".join(heads) + b"".join(bodies)


def unpack(data: bytes) -> np.ndarray:
    """The ids of a chunk."""
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    size, step = struct.unpack_from("<QI", data, 4)
    at = 16
    blocks = []
    for first in range(0, size, step):
        (used,) = struct.unpack_from("<I", data, at)
        lengths = struct.unpack_from(f"<{used.bit_count()}I", data, at + 4)
        at += 4 + 4 * len(lengths)
        blocks.append((min(step, size - first), used, lengths))
    expand = zstandard.ZstdDecompressor().decompress
    out = np.empty(size, "<u4")
    first = 0
    for count, used, lengths in blocks:
        kind = "<u2" if used < 1 << 16 else "<u4"
        block = np.zeros(count, kind)
        for k, length in zip((k for k in range(32) if used >> k & 1), lengths, strict=True):
            plane = np.unpackbits(np.frombuffer(expand(data[at : at + length]), np.uint8), count=count).astype(kind)
            block |= plane << np.array(k, kind)
            at += length
        out[first : first + count] = block
        first += count
    return out


class Encoder:
    """Ids of whole texts by the tokenizers library, with every distinct part encoded once.

    The vocabulary's pattern always ends a piece before a single space between two characters
    that are not white space. So a text is cut there and the library encodes each distinct part
    ` word` once; texts with other runs of white space around a cut are encoded in one go. A part
    that ends in punctuation after a letter or a digit is put together from the two.

    Added tokens keep the library's default: their strings in a text are the token. None of them
    holds a space.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [each.content for each in self.library.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.closings: dict[str, bytes] = {}
        # A token of this vocabulary has one character per byte it stands for.
        vocab = self.library.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, number in vocab.items():
            self.lengths[number] = len(token)

    def whole(self, texts: list[str]) -> list[bytes]:
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", each.ids).tobytes() for each in coded]

    def together(self, parts: list[str]) -> Iterator[bytes]:
        """Ids of each ` part`, encoded in long lines and cut apart where parts end.

        No piece crosses the space before a part, so the bytes that ids stand for tell where
        one part's ids end and the next one's start.
        """
        for first in range(0, len(parts), LINE_PARTS):
            line = parts[first : first + LINE_PARTS]
            coded = self.library.encode_batch_fast([f" {' '.join(line)}"], add_special_tokens=False)
            ids = np.array(coded[0].ids, "<u4")
            stops = np.cumsum([len(part) + 1 if part.isascii() else len(part.encode("utf-8")) + 1 for part in line])
            cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), stops) + 1) * 4
            data, at = ids.tobytes(), 0
            for cut in cuts.tolist():
                yield data[at:cut]
                at = cut

    def learn(self, parts: set[str]) -> None:
        """Puts the ids of every ` part` that can stand alone into `known`."""
        known = self.known
        split = {}
        new = [part for part in parts if part.isalnum()]
        for part in parts.difference(new):
            if not part or part != part.strip():
                continue
            stem = part.rstrip(CLOSING)
            if stem.isalnum():
                split[part] = stem, part[len(stem) :]
            elif stem and stem[-1].isalnum():
                # `end.` and `Next` of "end.\nNext" are found more often than the whole.
                first, feed, last = stem.partition("\n")
                before = first.rstrip(CLOSING)
                if feed and before and before[-1].isalnum() and last.isalnum():
                    split[part] = before, first[len(before) :] + feed, last, part[len(stem) :]
                else:
                    split[part] = stem, part[len(stem) :]
            else:
                split[part] = part, ""
        new += {each[0] for each in split.values()}.difference(known, new)
        known.update(zip(new, self.together(new), strict=True))
        closings = self.closings
        rest = list({piece for each in split.values() for piece in each[1:]}.difference(closings))
        closings.update(zip(rest, self.whole(rest), strict=True))
        for part, pieces in split.items():
            if len(pieces) == 2:
                known[part] = known[pieces[0]] + closings[pieces[1]]
            else:
                known[part] = known[pieces[0]] + b"".join([closings[piece] for piece in pieces[1:]])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        if len(self.known) + len(self.closings) > KEPT_PARTS:
            self.known.clear()
            self.closings.clear()
        get = self.known.get
        parts = [text.split(" ") for text in texts]
        openings = self.whole([part[0] for part in parts])
        found = [list(map(get, part[1:])) for part in parts]
        holes = [list(compress(range(len(each)), map(not_, each))) for each in found]
        self.learn({part[i + 1] for part, places in zip(parts, holes) for i in places})
        out = []
        for text, opening, part, ids, places in zip(texts, openings, parts, found, holes, strict=True):
            sound = part[0] == part[0].strip() and not any(word in text for word in self.special)
            for i in places:
                ids[i] = each = get(part[i + 1])
                sound = sound and each is not None
            if sound:
                out.append(opening + b"".join(ids))
            else:  # a part that cannot stand alone, or an added token
                out.append(self.whole([text])[0])
        return out


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(df: DataFrame, path: str, folder: str) -> None:
    """Token files of whole `df(doc_id, text)` in ascending doc_id order, ties by text.

    Null text is empty and has the end id alone; null ids come first; repeated rows stay.
    """
    docs = df.select(F.col("doc_id").cast("long"), raw("text"))
    ordered = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        part, first, number = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        names: list[int | None] = []
        sizes: list[int] = []

        def chunk() -> pa.RecordBatch:
            nonlocal first, number
            row = [part, number, first, list(names), list(sizes), pack(np.frombuffer(b"".join(ids), "<u4"))]
            first += sum(sizes)
            number += 1
            ids.clear(), names.clear(), sizes.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            fields = ["part", "chunk", "first", "doc_ids", "lengths", "planes"]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], fields)

        held = 0
        for batch in batches:
            texts = [value.as_py().decode("utf-8", "replace") for value in batch.column(1)]
            for doc_id, coded in zip(batch.column(0).to_pylist(), encode(texts)):
                each = coded + END_ID
                if ids and held + len(each) // 4 > CHUNK_IDS:
                    yield chunk()
                    held = 0
                ids.append(each)
                names.append(doc_id)
                sizes.append(len(each) // 4)
                held += len(each) // 4
        if ids:
            yield chunk()

    schema = "part int, chunk int, first long, doc_ids array<bigint>, lengths array<bigint>, planes binary"
    map_batches(ordered, run, schema).write.parquet(folder)


def read(spark, folder: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids binary) from token files; start counts ids before."""
    stored = spark.read.parquet(folder)
    totals = {
        row.part: row.total
        for row in stored.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, b: a + b)).alias("total")).collect()
    }  # one number per file
    offsets, before = {}, 0
    for part in sorted(totals):
        offsets[part], before = before, before + totals[part]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, at, start = unpack(row["planes"]), 0, offsets[row["part"]] + row["first"]
                starts, slices = [], []
                for length in row["lengths"]:
                    starts.append(start + at)
                    slices.append(ids[at : at + length].tobytes())
                    at += length
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["lengths"], pa.int64()), pa.array(slices, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return map_batches(stored, run, "doc_id long, start long, n_tokens long, ids binary")


def result(df: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, from the files that hold the texts of `df`."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    write(df, path, folder)
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The pieces of many texts are taken together: an inverted index maps each merge rank to the
places where a neighbouring pair makes that merge, and the merges are applied in rank order.
A merge touches only the two pairs beside it, so the work follows the number of merges, not
ranks times text. Words are independent of each other under BPE, so replaying any block of
distinct pieces gives each of them what it would get alone; a task replays the new pieces of a
block of texts and keeps them for the next block.

Edge cases: null text counts as empty (no ids, digests of nothing); bytes that are not UTF-8
are read as U+FFFD; repeated rows each give a row; extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import map_batches, raw

#: Distinct pieces that a worker remembers, and characters of text that it handles together.
KEPT_PIECES = 400_000
BLOCK_CHARS = 2_000_000


class Vocabulary:
    """Merge ranks from a file of base64 tokens, and the piece pattern that goes with them."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        # White space is the Unicode property here, as in the library whose ids must be met.
        pattern = pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
        self.every = regex.compile(pattern).findall
        self.latin = re.compile(self._narrow(pattern)).findall
        self.single = [self.ranks[bytes([value])] for value in range(256)]
        self.known: dict[str, bytes] = {}
        self._pairs: dict[int, int] = {}

    @staticmethod
    def _narrow(pattern: str) -> str:
        """The pattern for texts of code points below 256, in terms of the faster `re`."""
        import regex

        def members(name: str) -> str:
            kind = regex.compile(name)
            return "".join(rf"\x{value:02x}" for value in range(256) if kind.match(chr(value)))

        def spell(found) -> str:
            if found[0].startswith("["):
                return regex.sub(r"\\[pP]\{\w+\}", lambda name: members(name[0]), found[0])
            return f"[{members(found[0])}]"

        return regex.sub(r"\[\^?[^\]]*\]|\\[pP]\{\w+\}", spell, pattern)

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return self.latin(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.every(text)
        return self.latin(text)

    def _rank(self, left: int, right: int) -> int:
        """Rank of the token that a pair makes, or -1; remembered."""
        found = self._pairs[left << 20 | right] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of every word: all merges of all words, in rank order."""
        single = self.single
        ids: list[int] = []
        owner: list[int] = []
        for number, word in enumerate(words):
            ids += [single[value] for value in word]
            owner += [number] * len(word)
        size = len(ids)
        owner.append(-1)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        index: dict[int, list[int]] = {}
        pairs, look = self._pairs, self._rank
        for place in range(size - 1):
            if owner[place] == owner[place + 1]:
                rank = pairs.get(ids[place] << 20 | ids[place + 1])
                if rank is None:
                    rank = look(ids[place], ids[place + 1])
                if rank >= 0:
                    if rank in index:
                        index[rank].append(place)
                    else:
                        index[rank] = [place]
        queue = list(index)
        heapify(queue)
        while queue:
            rank = heappop(queue)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            earlier: set[int] = set()  # words in which a merge of lower rank has become possible
            later: list[int] = []
            for place in places:
                left = ids[place]
                word, right = owner[place], after[place]
                if left < 0 or owner[right] != word or pairs.get(left << 20 | ids[right]) != rank:
                    continue
                if word in earlier:
                    later.append(place)
                    continue
                ids[place], ids[right] = rank, -1
                after[place] = beyond = after[right]
                start = before[place]
                if owner[beyond] == word:
                    before[beyond] = place
                    made = pairs.get(rank << 20 | ids[beyond])
                    if made is None:
                        made = look(rank, ids[beyond])
                    if made >= 0:
                        if made in index:
                            index[made].append(place)
                        else:
                            index[made] = [place]
                            heappush(queue, made)
                        if made <= rank:
                            earlier.add(word)
                if owner[start] == word:
                    made = pairs.get(ids[start] << 20 | rank)
                    if made is None:
                        made = look(ids[start], rank)
                    if made >= 0:
                        if made in index:
                            index[made].append(start)
                        else:
                            index[made] = [start]
                            heappush(queue, made)
                        if made <= rank:
                            earlier.add(word)
            if later:
                if rank not in index:
                    index[rank] = []
                    heappush(queue, rank)
                index[rank].extend(later)
        out: list[list[int]] = [[] for _ in words]
        for place, rank in enumerate(ids):
            if rank >= 0:
                out[owner[place]].append(rank)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pieces = [self.pieces(text) for text in texts]
        known = self.known
        new: dict[bytes, str] = {}
        for piece in set().union(*pieces).difference(known):
            word = piece.encode("utf-8")
            rank = self.ranks.get(word)
            if rank is None:
                new[word] = piece
            else:
                known[piece] = rank.to_bytes(4, "little")
        for (_, piece), ids in zip(new.items(), self.replay(list(new)), strict=True):
            known[piece] = np.array(ids, "<u4").tobytes()
        out = [b"".join(map(known.__getitem__, each)) for each in pieces]
        if len(known) > KEPT_PIECES:
            known.clear()
            self._pairs.clear()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def blocks(texts: Iterable[bytes]) -> Iterator[list[str]]:
    """Decoded texts in runs of about BLOCK_CHARS; a longer text is a run of its own."""
    run: list[str] = []
    held = 0
    for text in texts:
        run.append(text.decode("utf-8", "replace"))
        held += len(run[-1])
        if held >= BLOCK_CHARS:
            yield run
            run, held = [], 0
    if run:
        yield run


def encode_texts(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """Rows (key, ids binary, decoded binary) of every row; ids are little-endian 32 bits."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        for batch in batches:
            start = 0
            for part in blocks(value.as_py() for value in batch.column(1)):
                ids = vocab.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(part)),
                        pa.array(ids, pa.binary()),
                        pa.array([vocab.decode(each) for each in ids], pa.binary()),
                    ],
                    ["key", "ids", "decoded"],
                )
                start += len(part)

    mapped = map_batches(df.select(F.col(key), raw(text)), run, f"key {kind}, ids binary, decoded binary")
    return mapped.withColumnRenamed("key", key)


def digests(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of whole `documents` texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            start = 0
            for part in blocks(value.as_py() for value in batch.column(1)):
                ids = vocab.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(part)),
                        pa.array([len(each) // 4 for each in ids], pa.int64()),
                        pa.array(map(sha, ids), pa.string()),
                        pa.array([sha(vocab.decode(each)) for each in ids], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
                start += len(part)

    return map_batches(
        df.select(F.col("doc_id").cast("long"), raw("text")),
        run,
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )

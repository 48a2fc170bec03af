"""Log probabilities of words over all their segmentations into the pieces of a vocabulary.

A word is the space that opens it and its bytes. Every way to cut it into pieces counts, with
the product of its pieces' probabilities; single bytes are pieces too, so no word is
impossible. Words of one length are handled together: the forward recursion runs over end
places, in log space, for all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(1_099_511_628_211)
_OPEN = np.uint64(14_695_981_039_346_656_037)
_BITS = 20


def piece_bytes(model_file: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a sentencepiece file as bytes (a space opens words) and their scores.

    Control and unknown pieces are left out. All 256 single bytes are present: byte pieces and
    equal plain pieces become one, with the better score.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    best: dict[bytes, float] = {}
    lowest = min(model.get_score(i) for i in range(model.get_piece_size()))
    for value in range(256):
        best[bytes([value])] = lowest - 1
    for i in range(model.get_piece_size()):
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        name = model.id_to_piece(i)
        if model.is_byte(i):
            piece, score = bytes([int(name[3:5], 16)]), lowest - 1
        else:
            piece, score = name.replace("▁", " ").encode("utf-8").lower(), model.get_score(i)
        best[piece] = max(best.get(piece, lowest - 1), score)
    pieces = sorted(best)
    return pieces, np.array([best[piece] for piece in pieces])


def zipf(scores: np.ndarray) -> np.ndarray:
    """Probabilities from scores that are negative merge ranks: by Zipf's law, 1 / (rank + 2)."""
    weights = 1.0 / (scores.max() - scores + 2.0)
    return weights / weights.sum()


class Lattice:
    """Pieces with natural-log weights, found by the hash of their bytes."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.weights = np.append(np.asarray(weights, np.float64), -np.inf)
        self.longest = max(map(len, pieces))
        hashes = np.array([self._hash(piece) for piece in pieces], np.uint64)
        if len(set(hashes.tolist())) != len(pieces):
            raise ValueError("two pieces share a hash")
        self.levels: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        left = np.arange(len(pieces))
        factor = 0x9E3779B97F4A7C15
        while len(left):
            factor = (factor * 0xD1342543DE82EF95 + 1) % 2**64 | 1
            slots = self._slots(hashes[left], np.uint64(factor))
            _, first = np.unique(slots, return_index=True)
            key, value = np.zeros(1 << _BITS, np.uint64), np.full(1 << _BITS, len(pieces), np.int32)
            key[slots[first]], value[slots[first]] = hashes[left[first]], left[first]
            self.levels.append((np.uint64(factor), key, value))
            left = np.delete(left, first)

    @staticmethod
    def _hash(piece: bytes) -> int:
        out = int(_OPEN)
        for value in piece:
            out = (out * int(_BASE) + value + 1) % 2**64
        return out

    @staticmethod
    def _slots(hashes: np.ndarray, factor: np.uint64) -> np.ndarray:
        return ((hashes * factor) >> np.uint64(64 - _BITS)).astype(np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece numbers; the number of pieces where there is none."""
        out = np.full(len(hashes), len(self.weights) - 1, np.int32)
        for factor, key, value in self.levels:
            slots = self._slots(hashes, factor)
            hit = key[slots] == hashes
            out[hit] = value[slots[hit]]
        return out

    def _edges(self, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(start, stop, piece numbers) of all stretches of words of one length."""
        length = rows.shape[1]
        wide = rows.astype(np.uint64) + np.uint64(1)
        for start in range(length):
            hashes = np.full(len(rows), _OPEN)
            for stop in range(start + 1, min(length, start + self.longest) + 1):
                hashes = hashes * _BASE + wide[:, stop - 1]
                found = self._find(hashes)
                if (found < len(self.weights) - 1).any():
                    yield start, stop, found

    @staticmethod
    def by_length(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, bytes of ` word`) of the words of each length, in bounded runs."""
        lengths = np.array([len(word) for word in words])
        for length in np.unique(lengths):
            places = np.nonzero(lengths == length)[0]
            step = max(1, 2_000_000 // (int(length) + 1) ** 1)
            for first in range(0, len(places), step):
                part = places[first : first + step]
                joined = b"".join(b" " + words[i] for i in part)
                yield part, np.frombuffer(joined, np.uint8).reshape(len(part), -1)

    def score(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability, summed over all segmentations."""
        out = np.empty(len(words))
        for places, rows in self.by_length(words):
            out[places] = self._forward(rows, None)[:, -1]
        return out

    def _forward(self, rows: np.ndarray, edges: list | None) -> np.ndarray:
        forward = np.full((len(rows), rows.shape[1] + 1), -np.inf)
        forward[:, 0] = 0.0
        for start, stop, found in self._edges(rows):
            # All edges into `start` come from earlier starts, so its value is final here.
            forward[:, stop] = np.logaddexp(forward[:, stop], forward[:, start] + self.weights[found])
            if edges is not None:
                edges.append((start, stop, found))
        return forward

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Expected use of each piece over `counts` copies of the words."""
        total = np.zeros(len(self.weights))
        for places, rows in self.by_length(words):
            edges: list = []
            forward = self._forward(rows, edges)
            backward = np.full_like(forward, -np.inf)
            backward[:, -1] = 0.0
            for start, stop, found in reversed(edges):
                backward[:, start] = np.logaddexp(backward[:, start], backward[:, stop] + self.weights[found])
            for start, stop, found in edges:
                share = np.exp(forward[:, start] + self.weights[found] + backward[:, stop] - forward[:, -1])
                total += np.bincount(found, share * counts[places], len(total))
        return total[:-1]

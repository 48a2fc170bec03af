"""Ids of whole texts by the tokenizers library's word vocabulary, every distinct word encoded once.

The vocabulary drops white space and no piece of it crosses a blank or a line feed, so a text is
cut there. A word is looked up as it stands, then without its closing punctuation, then (plain
ASCII) in lower case; only what is still unknown goes through the library. Added tokens keep the
library's default: their strings in a text are the token.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress
from operator import not_

import numpy as np

#: Closing marks that are a piece of their own after a letter or a digit.
CLOSING = ".,;:!?%#*&$"
#: Words whose ids a worker remembers.
KEPT_WORDS = 1_000_000
#: Words that are encoded as one line.
LINE_WORDS = 2_000


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        for token, number in vocab.items():
            self.closes[number] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        coded = self.library.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", each.ids).tobytes() for each in coded]

    def lines(self, words: list[str]) -> Iterator[bytes]:
        """Ids of words of letters only. Each is one piece, whose last id alone closes a word."""
        for first in range(0, len(words), LINE_WORDS):
            line = words[first : first + LINE_WORDS]
            ids = np.frombuffer(self.whole([" ".join(line)])[0], "<u4")
            stops = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(stops) != len(line):
                yield from self.whole(line)
                continue
            data, at = ids.tobytes(), 0
            for stop in stops.tolist():
                yield data[at:stop]
                at = stop

    def learn(self, words: set[str]) -> None:
        """Puts the ids of unknown words into `known`."""
        known = self.known
        parts = {}
        for word in words:
            stem = word.rstrip(CLOSING)
            if stem and not stem[-1].isalnum():
                stem = word
            parts[word] = (stem.lower() if stem.isascii() and "<|" not in stem else stem), word[len(stem) :]
        new = {part for pair in parts.values() for part in pair}.difference(known)
        plain = [part for part in new if part.isalpha()]
        other = [part for part in new if part and not part.isalpha()]
        known.update(zip(plain, self.lines(plain), strict=True))
        known.update(zip(other, self.whole(other), strict=True))
        known.setdefault("", b"")
        for word, (stem, tail) in parts.items():
            known[word] = known[stem] + known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit integers."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        get = self.known.get
        words = [text.replace("\n", " ").split(" ") for text in texts]
        # Words without ids (empty ones) look unknown here; they are learnt again at no cost.
        found = [list(map(get, each)) for each in words]
        holes = [list(compress(range(len(each)), map(not_, each))) for each in found]
        self.learn({each[i] for each, places in zip(words, holes) for i in places})
        for each, ids, places in zip(words, found, holes):
            for i in places:
                ids[i] = self.known[each[i]]
        return [b"".join(ids) for ids in found]


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)

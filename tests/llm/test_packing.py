import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, documents
from tokenizers import Tokenizer

from tidemark.llm import packing
from tidemark.llm.word_pieces import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "  two  blanks ", "tab\t x", "a\n\nb \n x", "<|endoftext|> y <|ENDOFTEXT|>. x<|startoftext|>,", "end. End, END; 3.5! (x). --.",
    "J̌ ǰ ́a é İ ΣΣ é. É.", "don't I'LL we're. 's 't.", "a　b c\x1cd \x85", "?!. .", "x̸< ≮.", "12ab. ½. 中文. \U0001f600.",
]


def test_words_encode_as_whole_texts():
    coder = WordEncoder(PATH)
    texts = [text or "" for _, text in TEXTS] + ODD
    want = coder.whole(texts)
    assert coder.encode(texts) == want
    assert coder.encode(texts) == want  # now from what it remembers


def plain(lengths, room):
    """The rule word by word: try every open sequence, add up the squares."""
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i] != room, -lengths[i], i))
    gaps = []
    for i in order:
        size = lengths[i]
        if size == room:
            gaps.append(0)
            continue
        choices = []
        for gap in sorted({gap for gap in gaps if gap >= size}):
            counts = defaultdict(int)
            for each in gaps:
                counts[each] += 1
            counts[gap] -= 1
            counts[gap - size] += 1
            choices.append((sum(n * n for g, n in counts.items() if g), gap))
        if choices:
            gap = min(choices)[1]
            gaps[gaps.index(gap)] -= size
        else:
            gaps.append(room - size)
    return sorted(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_squares_against_the_plain_rule(seed):
    pick = np.random.default_rng(seed)
    room = int(pick.integers(5, 40))
    lengths = pick.integers(1, room + 1, int(pick.integers(0, 120)))
    sequence, offset, used = packing.squares(lengths, room)
    left = np.full(used, room)
    for number in range(used):
        mine = np.flatnonzero(sequence == number)
        mine = mine[np.argsort(offset[mine])]
        assert offset[mine].tolist() == np.cumsum([0, *lengths[mine]])[:-1].tolist()
        left[number] -= lengths[mine].sum()
    assert (left >= 0).all()
    assert sorted(left.tolist()) == plain(lengths.tolist(), room)


def check(rows, texts, room):
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for number, first in enumerate(range(0, len(ids), room)):
            part = np.array(ids[first : first + room], "<u4").tobytes()
            want.append((doc_id, number, first, len(part) // 4, zlib.crc32(part)))
    key = lambda row: tuple((x is not None, x or 0) for x in row)
    assert sorted((tuple(row)[:5] for row in rows), key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for row in rows:
        held[row.sequence_id].append((row.offset, row.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= room
    return held


@pytest.mark.parametrize("room", [packing.ROOM, 7])
def test_every_document_has_its_place(spark, room):
    texts = TEXTS + [(100 + i, text) for i, text in enumerate(ODD)]
    check(packing.result(documents(spark, texts), PATH, room).collect(), texts, room)


def test_as_few_sequences_as_there_can_be(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.result(docs, PATH).collect()
    held = check(rows, [(row.doc_id, row.text) for row in docs.collect()], packing.ROOM)
    assert len(held) == -(-sum(row.length for row in rows) // packing.ROOM)


def test_windows_of_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOW_PIECES", 3)
    check(packing.result(documents(spark), PATH, 50).collect(), TEXTS, 50)


def test_empty_table(spark):
    assert packing.result(documents(spark, []), PATH).count() == 0

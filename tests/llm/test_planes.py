import zlib

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, documents
from tokenizers import Tokenizer

from tidemark.llm import planes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_round_trip_of_blocks():
    for size in (0, 1, 7, planes.BLOCK_IDS, planes.BLOCK_IDS + 1, 50_000):
        ids = np.random.default_rng(size).integers(0, 50_257, size).astype("<u4")
        assert (planes.unpack(planes.pack(ids)) == ids).all()
    edge = np.array([2**32 - 1, 0, 5, 1 << 31], "<u4")
    assert (planes.unpack(planes.pack(edge)) == edge).all()
    with pytest.raises(ValueError):
        planes.unpack(b"nothing of the kind")


def test_parts_encode_as_whole_texts():
    coder = planes.Encoder(PATH)
    texts = [text or "" for _, text in TEXTS] + ["  two  blanks ", "tab\t x", "nl \n x", "<|endoftext|> y", " x", "a \x85 b"]
    texts += ["a <|endoftext|> b", "z<|endoftext|>.", "end. End, (x). 3.5! --. 's. x.'s don't. é. ½. 中., w.\nNext, y", "so?!. it's, a.b."]
    library = Tokenizer.from_file(PATH)
    want = [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text in texts]
    assert coder.encode(texts) == want
    assert coder.encode(texts) == want  # now from what it remembers


@pytest.mark.parametrize("chunk", [planes.CHUNK_IDS, 4])
def test_files_hold_all_documents_in_order(spark, chunk, monkeypatch):
    monkeypatch.setattr(planes, "CHUNK_IDS", chunk)
    library = Tokenizer.from_file(PATH)
    texts = [*TEXTS, (500, "a <|endoftext|> b")]
    rows = sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    start, want = 0, []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = sorted((tuple(row) for row in planes.result(documents(spark, texts), PATH).collect()), key=lambda x: x[1])
    assert got == want


def test_empty_table(spark):
    assert planes.result(documents(spark, []), PATH).count() == 0

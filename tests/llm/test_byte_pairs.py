import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from cases import TEXTS, documents

from tidemark.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def library():
    ranks = byte_pairs.vocabulary(PATH, public_tokenizers.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_the_library_on_odd_text():
    vocab, want = byte_pairs.Vocabulary(PATH, public_tokenizers.PATTERN), library()
    pick = random.Random(5)
    letters = "abcetnoihs    \n\t'\x1c\x1f\x85\u00a0éüß123½漢😀!?.|$́ⅷ"
    texts = ["".join(pick.choice(letters) for _ in range(pick.randint(0, 70))) for _ in range(3_000)]
    texts += ["a" * n for n in range(50)] + ["ab" * 3_000, "<|endoftext|> <|endoftext|>", "\r\n \r\n  x"]
    for text, ids in zip(texts, vocab.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.encode_ordinary(text), repr(text)
        assert vocab.decode(ids) == text.encode()


def test_forgetting_pieces_changes_nothing(monkeypatch):
    monkeypatch.setattr(byte_pairs, "KEPT_PIECES", 3)
    vocab, want = byte_pairs.Vocabulary(PATH, public_tokenizers.PATTERN), library()
    for text in ["some words and others", "others and some words again", ""]:
        assert np.frombuffer(vocab.encode([text])[0], "<u4").tolist() == want.encode_ordinary(text)


def test_digests_of_all_rows(spark):
    rows = byte_pairs.digests(documents(spark), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text in TEXTS:
        ids = np.array(library().encode_ordinary(text or ""), "<u4")
        want.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_empty_table_and_ids(spark):
    none = byte_pairs.digests(documents(spark, []), PATH, public_tokenizers.PATTERN)
    assert none.count() == 0
    coded = byte_pairs.encode_texts(documents(spark, [(1, "hello world"), (2, None)]), "doc_id", "text", PATH, public_tokenizers.PATTERN)
    found = {row.doc_id: (bytes(row.ids), bytes(row.decoded)) for row in coded.collect()}
    assert found[1][1] == b"hello world" and found[2] == (b"", b"")

import math
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from cases import TEXTS, documents, remainder

from tidemark.llm import language_model
from tidemark.llm.lattice import Lattice
from tidemark.llm.texts import bucket_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def forward(word, weights):
    text, reach = b" " + word, [0.0]
    for stop in range(1, len(text) + 1):
        reach.append(-math.inf)
        for start in range(stop):
            if text[start:stop] in weights:
                reach[stop] = np.logaddexp(reach[stop], reach[start] + weights[text[start:stop]])
    return reach[-1]


def test_lattice_sums_every_segmentation():
    pieces = [b" ", b" a", b"a", b"b", b"ab", b" ab", b"ba"]
    weights = np.log([0.1, 0.2, 0.1, 0.1, 0.2, 0.1, 0.2])
    words = [b"", b"a", b"ab", b"aba", b"abab", b"c"]
    got = Lattice(pieces, weights).score(words)
    for word, value in zip(words, got):
        want = forward(word, dict(zip(pieces, weights)))
        assert value == pytest.approx(want) or math.isinf(want) and math.isinf(value)
    # Expected uses: all segmentations of " ab", weighed by their share.
    used = Lattice(pieces, weights).expected([b"ab"], np.array([2.0]))
    ways = {(5,): 0.1, (1, 3): 0.02, (0, 4): 0.02, (0, 2, 3): 0.001}
    for piece in range(len(pieces)):
        want = 2 * sum(p for way, p in ways.items() if piece in way) / sum(ways.values())
        assert used[piece] == pytest.approx(want)


def expected_base(rows):
    counts = Counter()
    for doc_id, text in rows:
        if remainder(doc_id, 7) != 2:
            counts.update((text or "").encode().lower().split())
            counts[b" "] += 1
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split() + [b" "]
        base = sum(math.log10((counts[word] + 1) / (total + distinct + 1)) for word in words)
        out.append((doc_id, remainder(doc_id, 7) == 2, len(words), sum(counts[word] > 0 for word in words), total, base))
    return out


@pytest.mark.parametrize("head", [1_000_000, 30, 1])
def test_counts_base_and_score(spark, head):
    docs = documents(spark)
    rows = language_model.score_texts(docs, bucket_of("doc_id", 7) == 2, MODEL, head).collect()
    order = lambda x: (repr(x[0]), x[2], round(x[5], 6))
    for got, want in zip(sorted(map(tuple, rows), key=order), sorted(expected_base(TEXTS), key=order), strict=True):
        assert got[:5] == want[:5]
        assert got[5] == pytest.approx(want[5])
        assert got[6] < 0


def test_scores_do_not_depend_on_the_split(spark):
    docs = documents(spark)
    held = bucket_of("doc_id", 7) == 2
    whole = {(r.doc_id, r.n_tokens): r.score for r in language_model.score_texts(docs, held, MODEL).collect()}
    split = {(r.doc_id, r.n_tokens): r.score for r in language_model.score_texts(docs.repartition(5), held, MODEL, 2).collect()}
    assert whole.keys() == split.keys()
    for key, value in whole.items():
        assert split[key] == pytest.approx(value)


def test_empty_table(spark):
    assert language_model.result(documents(spark, []), MODEL).count() == 0

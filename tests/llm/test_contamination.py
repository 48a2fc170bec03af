import hashlib
import re

import pytest
from cases import TEXTS, documents, low

from tidemark.llm import contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TESTS = [
    (1, "The cat and the dog are on the mat. It is raining. The cat"),
    (2, "ONE two"),
    (2, "one"),
    (None, "no id at all"),
    (3, None),
    (4, "..."),
    (5, "ÜBER straße 漢字"),
    (6, " ".join(f"word{i % 977} of the {i}" for i in range(100, 120))),
]


def brute(text, tests):
    words, hit, items = WORD.findall(low(text)), set(), set()
    for item, source in tests:
        own = WORD.findall(low(source))
        size = min(13, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1) if windows else ():
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                items.add("" if item is None else str(item))
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return len(words), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("size", [64 * 1024 * 1024, 2_000])
def test_against_brute_force_with_one_and_with_many_automata(spark, size):
    tests = spark.createDataFrame([(i, text, 1) for i, text in TESTS], "item_id long, text string, row int")
    judged = contamination.judge(documents(spark), tests, ["doc_id"], automaton_bytes=size)
    got = [
        (x.row.doc_id, x.n_words, x.n_hit, len(x["items"]), hashlib.sha256(",".join(x["items"]).encode()).hexdigest(), x.contaminated)
        for x in judged.collect()
    ]
    want = [(doc_id, *brute(text, TESTS)) for doc_id, text in TEXTS]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_spans_point_into_the_original():
    text = "Say: ONE -- Two, three!".encode()
    automaton = contamination.build({b"one two": ["1"]})
    ranges, items = contamination.scan(automaton, contamination.words_of(text))
    assert ranges == [(1, 3)] and items == {"1"}
    assert [text[a:b] for a, b in contamination.spans_of(text, ranges)] == [b"ONE -- Two"]


def test_empty_tables_and_clean_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.result(documents(spark, []), none).count() == 0
    assert contamination.clean(docs, none).count() == docs.count()
    tests = spark.createDataFrame([(1, "one")], "item_id long, text string")
    kept = contamination.clean(docs, tests)
    assert kept.columns == docs.columns and 6 not in {row.doc_id for row in kept.collect()}


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    tests = [(row.item_id, row.text) for row in bench.collect()]
    got = {row.doc_id: tuple(row)[1:] for row in contamination.result(docs, bench).collect()}
    windows = {}
    for item, source in tests:
        own = WORD.findall(low(source))
        for i in range(max(1, len(own) - 12)):
            windows.setdefault(tuple(own[i : i + 13]), set()).add(str(item))
    for row in docs.collect():
        words, hit, items = WORD.findall(low(row.text)), set(), set()
        for size in {len(window) for window in windows}:
            for i in range(len(words) - size + 1):
                found = windows.get(tuple(words[i : i + size]))
                if found:
                    hit.update(range(i, i + size))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        assert got[row.doc_id] == (len(words), len(hit), len(items), digest, len(hit) > 0 and 20 * len(hit) >= len(words))

import random
import re
import textwrap

import pytest
from cases import documents

from tidemark.llm import licenses

FILLER = "some words about nothing in particular that stand here for the rest of a file and its code"


@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices_are_found(spark, mark):
    rows, want = [], {}
    for label, text in licenses.TEMPLATES:
        for before in (0, 45, 200):
            words = " ".join((FILLER.split() * 20)[:before])
            for width in (24, 72):
                rows.append((len(rows), "\n".join(mark + line for line in textwrap.wrap(f"{words} {text}. {FILLER}", width))))
                want[len(rows) - 1] = label
    got = {row.doc_id: row for row in licenses.result(documents(spark, rows)).collect()}
    assert all(label in got[i].labels.split(",") for i, label in want.items())
    assert all(row.score == 1.0 for row in got.values())


def test_runs_against_brute_force(spark):
    pick = random.Random(2)
    rows = []
    for i in range(60):
        words = re.findall("[0-9a-z]+", pick.choice(licenses.TEMPLATES)[1].lower())
        for _ in range(pick.randrange(8)):  # words between, more or fewer than a run may hold
            words.insert(pick.randrange(len(words)), "x")
        rows.append((i, "\n".join(["y"] * pick.randrange(90) + words + ["z"] * pick.randrange(90))))
    for row in licenses.result(documents(spark, rows)).collect():
        words, met = rows[row.doc_id][1].split("\n"), set()
        for label, text in licenses.TEMPLATES:
            every = set(licenses.template_words(text))
            span = -(-len(re.findall("[0-9a-z]+", text.lower())) * 5 // 4)
            if any(len(every & set(words[k : k + span])) >= 0.85 * len(every) - 1e-9 for k in range(len(words))):
                met.add(label)
        assert set(filter(None, row.labels.split(","))) == met | set(filter(None, row.base_labels.split(",")))

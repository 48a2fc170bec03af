import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import cover_tree, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid long, score long, kind int, group int, t string"


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, 3, 4, "t") for row in rows], SCHEMA)


def brute(rows):
    """All pairs in Python's whole numbers."""
    live = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        live.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    out = []
    for at, (anchor, vector, label) in enumerate(live):
        if anchor is None or anchor % 50:
            continue
        scored = []
        for other, (vec_id, values, its) in enumerate(live):
            if other != at:
                scored.append((-sum(a * b for a, b in zip(vector, values)), vec_id is None, vec_id or 0, vec_id, its))
        scored.sort(key=lambda x: x[:3])
        for score, _, _, positive, _ in [each for each in scored if each[-1] == label][:5]:
            fit = [each for each in scored if each[-1] != label and 50 * -score <= 100 * -each[0] <= 95 * -score]
            for rank, each in enumerate(fit[:3]):
                out.append((anchor, positive, rank + 1, each[3], -score, -each[0]))
    return Counter(out)


def clustered(seed, size, width=8, clusters=12):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(clusters, width))
    which = pick.integers(0, clusters, size)
    vectors = centres[which] + pick.normal(scale=0.15, size=(size, width))
    return vectors, which


@pytest.mark.parametrize("tree,leaf", [(2048, 32), (64, 4)])
def test_every_node_covers_its_rows_and_its_bounds_hold(tree, leaf, monkeypatch):
    monkeypatch.setattr(cover_tree, "TREE_ROWS", tree)
    monkeypatch.setattr(cover_tree, "LEAF_ROWS", leaf)
    vectors, labels = clustered(1, 700)
    vectors = np.floor(256 * np.concatenate([vectors, np.repeat(vectors[:1], 90, axis=0)]))
    ids = np.arange(len(vectors))
    forest = cover_tree.Forest(vectors, ids, ids, np.zeros(len(vectors), int))
    assert sorted(forest.uids.tolist()) == ids.tolist()
    points = cover_tree.augmented(forest.vectors, forest.norm)
    query = vectors[5]
    for start, each in forest.trees:
        for number, radius in enumerate(each.radius):
            rows = slice(start + each.first[number], start + each.last[number])
            centre = start + each.centre[number]
            assert (np.linalg.norm(points[rows] - points[centre], axis=1) <= radius).all()
            low, high = forest.bounds(np.array([forest.vectors[centre] @ query]), np.array([radius]), float(np.linalg.norm(query)))
            products = forest.vectors[rows] @ query
            assert low[0] <= products.min() and products.max() <= high[0]
        for number, children in each.children.items():
            centres = points[start + each.centre[children]]
            away = np.linalg.norm(centres[:, None] - centres[None], axis=2)[~np.eye(len(centres), dtype=bool)]
            level = math.ceil(math.log2(each.radius[number] / (1 + 1e-6) - 1e-3 - 1e-7 * forest.norm))
            assert (away > 2.0 ** (level - 1) - 1e-3).all()


def test_search_finds_the_best_and_leaves_out_far_nodes():
    vectors, which = clustered(2, 4000, clusters=60)
    vectors = np.floor(256 * vectors)
    ids = np.arange(len(vectors))
    forest = cover_tree.Forest(vectors, ids, ids, which)
    seen = 0
    for at in range(0, 4000, 97):
        products = vectors @ vectors[at]
        other = which != which[at]
        windows = [cover_tree.Best(3, 0.3 * top, 0.7 * top) for top in (products[at], products[at] * 0.9)]
        seen += forest.search(vectors[at], windows, lambda labels, uids: labels != which[at])
        for window in windows:
            fit = [i for i in ids if other[i] and window.low <= products[i] <= window.high]
            fit.sort(key=lambda i: (-products[i], i))
            assert [each[1] for each in window.found] == fit[:3]
    assert seen < 0.7 * 4000 * len(range(0, 4000, 97))


@pytest.mark.parametrize("groups", [1, 5])
def test_against_all_pairs(spark, groups, monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAST_GROUPS", groups)
    vectors, which = clustered(3, 600)
    rows = [(i, vectors[i].tolist(), int(which[i] % 5)) for i in range(600)]
    rows += [(50, vectors[3].tolist(), 2), (50, vectors[3].tolist(), 2), (None, vectors[9].tolist(), 1), (None, vectors[50].tolist(), 0)]
    rows += [(700 + i, vectors[0].tolist(), i % 3) for i in range(40)]  # one common vector, ties
    rows += [(800, None, 1), (850, vectors[1].tolist(), None), (900, [1.0, None], 1), (950, [float("nan")] * 8, 1), (1000, [float("inf")] * 8, 1)]
    rows += [(1050, [], 3), (1100, [0.5, 0.25], 2), (-50, vectors[2].tolist(), 1), (0, vectors[4].tolist(), 9)]
    got = Counter(tuple(row) for row in hard_negatives.result(table(spark, rows)).collect())
    assert got == brute(rows) and len(got) > 60


def test_large_components_stay_exact(spark):
    pick = np.random.default_rng(4)
    rows = [(10 * i, (pick.uniform(0.5, 1, 6) * 1e5).tolist(), int(i % 2)) for i in range(60)]
    got = Counter(tuple(row) for row in hard_negatives.result(table(spark, rows)).collect())
    assert got == brute(rows) and max(row[4] for row in got) > 2**48
    huge = [(50 * i, [3e38 * (i + 1) / 9], i % 2) for i in range(8)]
    # Products beyond a long are cut to its ends, and windows with them: no negative fits, nothing fails.
    assert hard_negatives.result(table(spark, huge)).count() == 0


def test_no_rows_no_anchors_one_label(spark):
    assert hard_negatives.result(table(spark, [])).count() == 0
    assert hard_negatives.result(table(spark, [(1, [0.5], 0), (2, [0.5], 1)])).count() == 0
    assert hard_negatives.result(table(spark, [(50, [0.5], 0), (51, [0.5], 0)])).count() == 0

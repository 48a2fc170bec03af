import random

import xxhash
from cases import TEXTS, documents
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.components import components


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(prints, ids, distance=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= distance:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, doc_id in enumerate(ids):
        if doc_id is not None:
            low[find(i)] = min(low.get(find(i), doc_id), doc_id)
    return [low.get(find(i)) for i in range(len(ids))]


def test_documents_against_brute_force(spark):
    prints = [plain(text) for _, text in TEXTS]
    want = [
        (doc_id, f"{fp:016x}", part)
        for (doc_id, _), fp, part in zip(TEXTS, prints, brute(prints, [i for i, _ in TEXTS]))
    ]
    got = [tuple(row) for row in simhash.result(documents(spark)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert simhash.result(documents(spark, [])).count() == 0


def test_links_lose_no_pair(spark):
    pick = random.Random(3)
    prints = {0, 2**64 - 1, 1 << 63}
    for _ in range(60):
        base = pick.getrandbits(64)
        prints.add(base)
        for _ in range(6):  # chains and stars of 0 to 5 differing bits, in one half or both
            other = base
            for bit in pick.sample(range(64) if pick.random() < 0.5 else range(28, 36), pick.randint(1, 5)):
                other ^= 1 << bit
            prints.add(other)
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in prints)
    classes = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, first_id long")
    for distance in (3, 1):
        want = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= distance}
        got = {(row.a, row.b) for row in simhash.links(classes, distance).collect()}
        assert got == want


def test_anchor_copies_are_few(spark):
    pick = random.Random(4)
    classes = spark.createDataFrame([(pick.getrandbits(63), i) for i in range(500)], "fp long, first_id long")
    copies = simhash.anchors(classes).groupBy("fp").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("int")).alias("homes"))
    top = copies.agg(F.max("n"), F.max("homes"), F.min("homes")).first()
    assert tuple(top) == (34, 2, 2)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(7, 7), (9, 8), (8, 9)]
    got = {row.node: row.component for row in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 141)} | {i: 500 for i in range(500, 540)} | {8: 8, 9: 8}
    assert got == want


def test_one_representative_of_each_group(spark):
    docs = documents(spark)
    kept = simhash.representatives(docs)
    assert kept.columns == docs.columns
    prints = [plain(text) for _, text in TEXTS]
    groups = brute(prints, [i for i, _ in TEXTS])
    named = {group for group in groups if group is not None}
    rows = kept.collect()
    assert sorted(row.doc_id for row in rows if row.doc_id is not None) == sorted(named)
    assert sum(row.doc_id is None for row in rows) == (None in groups)

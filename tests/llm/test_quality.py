import numpy as np
from cases import TEXTS, documents, remainder

from tidemark.llm import quality_classifier, quality_rules


def base(text):
    text = text or ""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, window in enumerate(windows):
        if windows.count(window) > 1:
            covered.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_base_counts(spark):
    rows = [x for x in TEXTS if len(x[1] or "") < 10_000]
    got = quality_rules.result(documents(spark, rows)).collect()
    want = [(doc_id, *base(text)) for doc_id, text in rows]
    assert sorted((tuple(row)[:7] for row in got), key=repr) == sorted(want, key=repr)
    assert all(not row.kept for row in got if row.base_failed)


def test_long_and_empty(spark):
    long = [x for x in TEXTS if len(x[1] or "") > 10_000]
    row = quality_rules.result(documents(spark, long)).first()
    assert row.n_words == 160_000
    assert quality_rules.result(documents(spark, [])).count() == 0


def test_divergence_rejects_odd_text_and_keeps_prose(spark):
    words = quality_rules.COMMON_WORDS["en"].split()
    pick = np.random.default_rng(1)
    shares = np.array(list(quality_rules.word_shares("en").values()))
    plain = [words[pick.choice(20, p=shares / shares.sum())] if pick.random() < shares.sum() else f"w{'abcdefgh'[i % 8]}{'aeiou'[i % 5]}{'rstlnm'[i // 40 % 6]}x" for i in range(300)]
    prose = " ".join(word + ("." if i % 9 == 8 else "") for i, word in enumerate(plain))
    junk = " ".join(f"{word}$$$%" for word in plain)
    rows = documents(spark, [(1, prose), (2, junk), (3, prose.upper()), (4, "few words only, nothing that one could judge by a distribution at all")])
    kept = quality_rules.kept(rows)
    assert kept.columns == rows.columns
    assert sorted(row.doc_id for row in kept.collect()) == [1, 4]


def test_classifier_learns_from_the_other_rows_only(spark):
    texts = [(i, f"good prose about thing {i} and the rest" if i % 3 else f"spam %%% win {i} $$$ now !!!") for i in range(300)]
    docs = documents(spark, texts + [(1000, None), (1001, ""), (None, "good prose")])
    marks = [(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (None, 1, 0), (7, int(7 % 3 == 0), 0)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = quality_classifier.result(docs, labels).collect()
    assert len(rows) == 303
    for row in rows:
        assert 0 <= row.score <= 1 and row.predicted == int(row.score >= 0.3)
        assert row.held_out == (remainder(row.doc_id, 5) == 0)
        if row.doc_id is not None and row.doc_id < 300 and row.held_out:
            assert row.predicted == int(row.doc_id % 3 > 0)
    # Turned labels of held-out rows change nothing.
    turned = [(i, 1 - q if remainder(i, 5) == 0 and q is not None else q, t) for i, q, t in marks]
    again = quality_classifier.result(docs, spark.createDataFrame(turned, labels.schema)).collect()
    assert sorted(map(tuple, again), key=repr) == sorted(map(tuple, rows), key=repr)


def test_classifier_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality_classifier.result(documents(spark), labels).collect()
    assert {row.score for row in rows} == {0.5}
    assert quality_classifier.result(documents(spark, []), labels).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    truth = {row.doc_id: row.quality for row in labels.collect()}
    rows = [row for row in quality_classifier.result(docs, labels).collect() if row.held_out]
    right = sum(row.predicted == truth[row.doc_id] for row in rows) / len(rows)
    assert right > 0.97


def test_word_shares_take_one_expression_for_all_words(spark):
    text = "The de la que der und, THE of-of e; on une für " * 12
    docs = documents(spark, [(1, text), (2, None)])
    measured = quality_rules.measured(docs)
    plain = [w for w in __import__("re").split(r"[\W\d_]+", text.lower()) if w]

    def distance(language):
        refs = quality_rules.word_shares(language)
        p = [plain.count(word) / len(text.split()) for word in refs]
        pairs = zip([*p, max(0.0, 1 - sum(p))], [*refs.values(), 1 - sum(refs.values())])
        halves = sum(x * np.log2(2 * x / (a + b)) for a, b in pairs for x in (a, b) if x > 0)
        return np.sqrt(halves / 2)

    got = {row.row.doc_id: row for row in measured.collect()}
    assert abs(got[1].word_distance - min(map(distance, quality_rules.COMMON_WORDS))) < 1e-9 and got[2].n_words == 0
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        assert measured._jdf.queryExecution().optimizedPlan().toString().count("replace(") < 20
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")

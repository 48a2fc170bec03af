"""Language-model scores: word frequencies as the base, a subword lattice as the model.

The corpus is counted once: every word of every text with its number of places in training
texts. The lattice takes the pieces and scores of an existing vocabulary; one round of expected
piece counts over all training words turns the scores into corpus probabilities. A text's score
is the log probability of its words, each summed over all segmentations, and of its end.

Words with at least a share of 1 / `head` of all training tokens go to every task, which are at
most `head` words at any size of the corpus; the other words of a text are dealt out by word and
meet their counts in a join, in which no word is frequent. Each text also sends one row under a key of its own, so no text is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.lattice import Lattice, piece_bytes, zipf
from tidemark.llm.texts import bucket_of, gathered, map_batches, raw
from tidemark.shared import materialise

#: Every task knows the words that make at least 1 / HEAD of all training tokens, so there are
#: at most HEAD of them; distinct words that a counting task holds before it passes them on;
#: weight of the vocabulary's own scores against expected counts.
HEAD = 1_000_000
HELD_WORDS = 400_000
#: Words whose lattices are computed together.
WORDS_TOGETHER = 40_000
PRIOR_WEIGHT = 1_000.0
#: The end of a text is counted under a key that is no word.
END = b" "
LN10 = math.log(10.0)


@lru_cache(2)
def _pieces(model_file: str) -> tuple[list[bytes], np.ndarray]:
    pieces, scores = piece_bytes(model_file)
    return pieces, zipf(scores)


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, c) of all words of `texts(text, learn)`; c counts places where `learn` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learnt: Counter = Counter()
        other: set = set()

        def rows() -> Iterator[pa.RecordBatch]:
            words = list(learnt) + [word for word in other if word not in learnt]
            counts = list(learnt.values()) + [0] * (len(words) - len(learnt))
            for first in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words[first : first + 50_000], pa.binary()), pa.array(counts[first : first + 50_000], pa.int64())],
                    ["word", "c"],
                )
            learnt.clear()
            other.clear()

        for batch in batches:
            for text, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                words = text.as_py().lower().split()
                if learn:
                    learnt.update(words)
                    learnt[END] += 1
                else:
                    other.update(words)
                if len(learnt) + len(other) > HELD_WORDS:
                    yield from rows()
        yield from rows()

    parts = map_batches(texts.select(raw("text"), "learn"), run, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


def trained(counts: DataFrame, model_file: str) -> tuple[np.ndarray, float]:
    """Natural-log weights of the pieces and of a text's end, from all training words."""
    pieces, prior = _pieces(model_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, start = _pieces(model_file)
        lattice = Lattice(known, np.log(start))
        total = np.zeros(len(known))
        for batch in gathered(batches, WORDS_TOGETHER):
            total += lattice.expected(batch.column(0).to_pylist(), np.asarray(batch.column(1), np.float64))
        used = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], ["piece", "n"])

    words = counts.where((F.col("c") > 0) & (F.col("word") != F.lit(END)))
    found = map_batches(words, run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    ends = counts.where(F.col("word") == F.lit(END)).agg(F.sum("c")).first()[0] or 0
    total = np.zeros(len(pieces))
    for row in found:  # at most one row per piece of the vocabulary
        total[row.piece] = row.n
    mass = total.sum() + ends + PRIOR_WEIGHT + 1
    return np.log((total + PRIOR_WEIGHT * prior) / mass), math.log((ends + 1) / mass)


def scored_words(counts: DataFrame, model_file: str, weights: np.ndarray) -> DataFrame:
    """Adds `lp`, the log10 probability of each word over all segmentations."""
    sent = counts.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(_pieces(model_file)[0], sent.value)
        for batch in gathered(batches, WORDS_TOGETHER):
            values = lattice.score(batch.column(0).to_pylist()) / LN10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["word", "c", "lp"])

    return map_batches(counts.where(F.col("word") != F.lit(END)), run, "word binary, c long, lp double")


def _sparse(texts: DataFrame, head: dict[bytes, tuple[float, float]]) -> DataFrame:
    """One row per text under its own key, one per other word: (word, text, n, doc)."""
    sent = texts.sparkSession.sparkContext.broadcast(head)
    doc_type = pa.struct(
        [
            ("doc_id", pa.int64()),
            ("held_out", pa.bool_()),
            ("n_tokens", pa.int64()),
            ("n_known", pa.int64()),
            ("base", pa.float64()),
            ("score", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            words: list[bytes] = []
            owners: list[int] = []
            places: list[int] = []
            docs: list[dict | None] = []
            for doc_id, text, held_out in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                number += 1
                found = Counter(text.as_py().lower().split())
                n_tokens = n_known = 0
                base = score = 0.0
                for word, n in found.items():
                    n_tokens += n
                    entry = known.get(word)
                    if entry is None:
                        words.append(word)
                        owners.append(number)
                        places.append(n)
                        docs.append(None)
                    else:
                        base += n * entry[0]
                        score += n * entry[1]
                        n_known += n
                words.append(b" %d" % number)
                owners.append(number)
                places.append(0)
                docs.append(
                    {"doc_id": doc_id, "held_out": held_out, "n_tokens": n_tokens, "n_known": n_known, "base": base, "score": score}
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array(owners, pa.int64()), pa.array(places, pa.int64()), pa.array(docs, doc_type)],
                ["word", "text", "n", "doc"],
            )

    schema = (
        "word binary, text long, n long, doc struct<doc_id:bigint,held_out:boolean,"
        "n_tokens:bigint,n_known:bigint,base:double,score:double>"
    )
    return map_batches(texts.select("doc_id", raw("text"), "held_out"), run, schema)


def score_texts(df: DataFrame, held_out, model_file: str, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    `held_out` is a column that says which rows are not learnt from. Null texts are empty: one
    end token. Without training texts all counts are zero and the vocabulary's scores stand
    alone. Repeated rows each count and each give a row; other columns are not read.
    """
    texts = df.select(F.col("doc_id").cast("long"), "text", held_out.alias("held_out"))
    counts = materialise(word_counts(texts.select("text", (~F.col("held_out")).alias("learn"))))
    weights, end_weight = trained(counts, model_file)
    words = materialise(scored_words(counts, model_file, weights))
    seen = counts.where("c > 0").agg(
        F.sum("c"), F.count("*"), F.sum(F.when(F.col("word") == F.lit(END), F.col("c")))
    ).first()
    total, distinct, ends = (value or 0 for value in seen)
    first = words.where((F.col("c") > 0) & (F.col("c") * F.lit(head) >= F.lit(total)))
    known = {bytes(row.word): (math.log10(row.c + 1), row.lp) for row in first.collect()}
    rows = _sparse(texts, known).join(words, "word", "left")
    summed = rows.groupBy("text").agg(
        F.max("doc").alias("doc"),
        F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("base"),
        F.sum(F.col("n") * F.coalesce("lp", F.lit(0.0))).alias("score"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("n_known"),
    )
    n_tokens = F.col("doc.n_tokens") + 1
    return summed.select(
        F.col("doc.doc_id").alias("doc_id"),
        F.col("doc.held_out").alias("held_out"),
        n_tokens.alias("n_tokens"),
        (F.col("doc.n_known") + F.col("n_known") + F.lit(int(ends > 0))).cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("doc.base") + F.col("base") + F.lit(math.log10(ends + 1)) - n_tokens * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("doc.score") + F.col("score") + F.lit(end_weight / LN10)).alias("score"),
    )


def result(df: DataFrame, model_file: str) -> DataFrame:
    return score_texts(df, bucket_of("doc_id", 7) == 2, model_file)

"""Quality classifier: naive Bayes features in a linear support vector machine.

A text is the set of its byte n-grams, hashed into a fixed number of buckets. Each indicator is
scaled by its bucket's class log-count ratio, and a linear hinge-loss model is fitted to the
scaled indicators by dual coordinate descent. Margins become probabilities by a logistic curve
fitted to margins of rows that took no part in a fit.

Fitting uses at most `max_rows` labelled texts, those with the smallest hash of their id; this
bound is a parameter and makes the sample fit the driver and a broadcast. Scoring reads every
text in whole, in one pass without a shuffle.

Edge cases: null text counts as empty (no features; the score is the curve's value at the
bias); labels that are null are left out, several labels of one id are averaged and a tie is
left out; without labels of both classes every score is the share of good labels, 0.5 without
any; repeated rows each give a row; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import bucket_of, map_batches, raw

MAX_ROWS = 4_000
BITS = 16
SIZES = (1, 2, 3, 4)
#: Shares of word pairs that repeat one word from which such a pair is an indicator of its own.
REPEATS = (0.005, 0.02, 0.08, 0.3)
#: Bytes of a text that are hashed at once; runs overlap, so no n-gram is lost.
RUN = 1 << 20


def features(text: bytes, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Sorted distinct buckets of the byte n-grams of a text.

    Word pairs count by one trait only, that both words are the same: the last buckets are set
    where such pairs have at least the shares of REPEATS.
    """
    present = np.zeros((1 << bits) + len(REPEATS), bool)
    words = text.split()
    same = sum(map(eq, words, islice(words, 1, None)))
    for k, share in enumerate(REPEATS):
        present[(1 << bits) + k] = same > share * len(words)
    for start in range(0, max(1, len(text)), RUN):
        data = np.frombuffer(text[start : start + RUN + max(sizes) - 1], np.uint8).astype(np.uint32)
        hashed = np.zeros(len(data), np.uint32)
        for size in range(1, max(sizes) + 1):
            if len(data) < size:
                break
            hashed = hashed[: len(data) - size + 1] * np.uint32(0x01000193) ^ (data[size - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1)
            if size in sizes:
                mixed = (hashed ^ hashed >> np.uint32(15)) * np.uint32(0x85EBCA6B)
                present[mixed >> np.uint32(32 - bits)] = True
    return np.nonzero(present)[0].astype(np.int32)


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS) -> np.ndarray:
    """log of each bucket's share in class 1 against its share in class 0, add-one smoothed."""
    counts = np.ones((2, (1 << bits) + len(REPEATS)))
    for row, label in zip(rows, labels):
        counts[int(label), row] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def descend(
    rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, cost: float = 0.1, rounds: int = 12, seed: int = 7
) -> tuple[np.ndarray, float]:
    """Weights per bucket (ratios included) and bias, by dual coordinate descent.

    Solves min |w|^2 / 2 + cost * sum of hinge losses; classes are balanced by their cost, the
    bias is one more feature of value 1.
    """
    signs = np.where(labels == 1, 1.0, -1.0)
    share = max(labels.mean(), 1e-9)
    limits = np.where(labels == 1, cost / (2 * share), cost / (2 * max(1 - share, 1e-9)))
    # Rows are scaled to unit length, so that long texts do not outweigh short ones.
    values = [ratios[row] for row in rows]
    norms = [float(np.sqrt((value**2).sum())) or 1.0 for value in values]
    values = [value / norm for value, norm in zip(values, norms)]
    square = [float((value**2).sum()) + 1.0 for value in values]
    weights, bias = np.zeros(len(ratios)), 0.0
    dual = np.zeros(len(rows))
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            row, value = rows[i], values[i]
            slope = signs[i] * (weights[row] @ value + bias) - 1.0
            moved = min(max(dual[i] - slope / square[i], 0.0), limits[i])
            if moved != dual[i]:
                step = (moved - dual[i]) * signs[i]
                weights[row] += step * value
                bias += step
                dual[i] = moved
    return weights, bias


def margin(row: np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float) -> float:
    value = ratios[row]
    return float(weights[row] @ value) / (float(np.sqrt((value**2).sum())) or 1.0) + bias


def curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve of labels over margins, by Newton steps."""
    good = labels.sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (len(labels) - good + 2))
    slope, offset = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w = p * (1 - p) + 1e-9
        gradient = np.array([((p - target) * margins).sum(), (p - target).sum()])
        hessian = np.array([[(w * margins**2).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(offset)


class Model:
    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, folds: int = 3):
        self.share = float(labels.mean()) if len(labels) else 0.5
        self.sound = len(labels) >= 2 * folds and 0 < labels.sum() < len(labels)
        if not self.sound:
            return
        # Margins for the curve come from folds that the fit has not seen.
        fold = np.arange(len(rows)) % folds
        margins = np.zeros(len(rows))
        for k in range(folds):
            inside = np.nonzero(fold != k)[0]
            picked = [rows[i] for i in inside]
            ratios = log_count_ratios(picked, labels[inside], bits)
            weights, bias = descend(picked, labels[inside], ratios)
            for i in np.nonzero(fold == k)[0]:
                margins[i] = margin(rows[i], ratios, weights, bias)
        self.slope, self.offset = curve(margins, labels)
        self.ratios = log_count_ratios(rows, labels, bits)
        self.weights, self.bias = descend(rows, labels, self.ratios)

    def score(self, row: np.ndarray) -> float:
        """Probability of label 1."""
        if not self.sound:
            return self.share
        value = self.slope * margin(row, self.ratios, self.weights, self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(value, -30, 30))))


def training_rows(texts: DataFrame, labels: DataFrame, max_rows: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Features and labels of at most `max_rows` texts that are not held out."""
    named = (
        labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
        .where(bucket_of("doc_id", 5) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.avg("quality").alias("quality"))
        .where("quality != 0.5")
    )
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # At most max_rows short rows: a broadcast of known size, so texts are not shuffled.
    joined = texts.join(F.broadcast(sample), "doc_id").select("doc_id", raw("text"), (F.col("quality") > 0.5).cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(value.as_py()).tobytes() for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["doc_id", "label", "row"])

    mapped = map_batches(joined, run, "doc_id long, label int, row binary")
    # One text per id, so repeated rows do not pass the bound.
    found = mapped.groupBy("doc_id").agg(F.min(F.struct("row", "label")).alias("x")).orderBy("doc_id").collect()
    rows = [np.frombuffer(bytes(each.x.row), np.int32) for each in found]
    return rows, np.array([each.x.label for each in found], np.int64)


def scores(df: DataFrame, labels: DataFrame, held_out: Column, max_rows: int = MAX_ROWS, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of `df(doc_id, text)`."""
    texts = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = df.sparkSession.sparkContext.broadcast(Model(*training_rows(texts, labels, max_rows)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            found = [model.score(features(value.as_py())) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.float64())], ["doc_id", "held_out", "score"])

    mapped = map_batches(texts.select("doc_id", raw("text"), held_out.alias("held_out")), run, "doc_id long, held_out boolean, score double")
    return mapped.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def result(df: DataFrame, labels: DataFrame) -> DataFrame:
    return scores(df, labels, bucket_of("doc_id", 5) == 0)

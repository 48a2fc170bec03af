"""Pluggable text classification: each distinct text is classified once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import ship_package

# Fixed values ------------------------------------------------------------------------
UNCERTAIN = "uncertain"
DIRECTIONS = ("positive", "negative", "neutral", UNCERTAIN)
# -------------------------------------------------------------------------------------

RESULT_SCHEMA = "text_hash string, direction string, impact double, confidence double, cached boolean"
Classifier = Callable[[pd.Series], pd.DataFrame]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def event_problem() -> Column:
    """Why a classifier result is unusable, null when it is sound."""
    return F.when(
        ~F.coalesce(F.col("direction").isin(*DIRECTIONS), F.lit(False)), "unknown direction"
    ).when(
        ~F.coalesce(
            F.col("impact").between(0, 1) & F.col("confidence").between(0, 1), F.lit(False)
        ),
        "impact and confidence must be in [0, 1]",
    )


def classify_distinct(
    documents: DataFrame,
    classifier: Classifier,
    *,
    text: str = "text",
    cache: DataFrame | None = None,
    model: str = "model",
    prompt_version: str = "v1",
) -> DataFrame:
    """Attach a classification to every document.

    Texts are reduced to one row per hash with map-side combining before Python sees them,
    and hashes already in `cache` (text_hash, model, prompt_version, direction, impact,
    confidence) are skipped. Only hashes are joined back, never the texts. A text on which the
    classifier fails, and every unsound result, becomes `uncertain` and is not to be cached.
    """
    hashed = documents.withColumn("text_hash", content_hash(F.col(text)))
    distinct = hashed.groupBy("text_hash").agg(F.first(text).alias("__text"))
    hits = None
    if cache is not None:
        hits = cache.filter(
            (F.col("model") == model) & (F.col("prompt_version") == prompt_version)
        ).select("text_hash", "direction", "impact", "confidence", F.lit(True).alias("cached"))
        distinct = distinct.join(hits.select("text_hash"), "text_hash", "left_anti")

    names = ["direction", "impact", "confidence"]

    def judged(texts: pd.Series) -> pd.DataFrame:
        """Answers with `cached`; if the classifier fails on several texts, each is tried alone."""
        try:
            out = classifier(texts)[names].set_index(texts.index)
            out["cached"] = True
            return out
        except Exception:  # noqa: BLE001  (a failing classifier must not fail the job)
            if len(texts) > 1:
                return pd.concat([judged(texts.iloc[i : i + 1]) for i in range(len(texts))])
            failed = {"direction": UNCERTAIN, "impact": 0.0, "confidence": 0.0, "cached": False}
            return pd.DataFrame(failed, index=texts.index)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = judged(batch["__text"])
            out.insert(0, "text_hash", batch["text_hash"])
            yield out

    ship_package(documents.sparkSession)
    fresh = distinct.mapInPandas(run, RESULT_SCHEMA)
    sound = event_problem().isNull()
    fresh = fresh.select(
        "text_hash",
        F.when(sound, F.col("direction")).otherwise(UNCERTAIN).alias("direction"),
        F.when(sound, F.col("impact")).otherwise(0.0).alias("impact"),
        F.when(sound, F.col("confidence")).otherwise(0.0).alias("confidence"),
        (F.col("cached") & sound).alias("cached"),
    )
    answers = fresh if hits is None else fresh.unionByName(hits)
    return hashed.drop(text).join(answers.withColumnRenamed("cached", "cacheable"), "text_hash", "left")

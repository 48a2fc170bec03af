"""Walk-forward evidence for a small logistic baseline.

Ordering and fold assignment are DataFrame work; only the fit of one fold (a bounded number
of rows set by the policy) runs as a numpy loop inside a grouped map, one fold per group.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import is_finite, sigmoid
from tidemark.operators.ordering import position, rising_text
from tidemark.operators.segments import SEGMENT_ROWS
from tidemark.policies import ModelWindows
from tidemark.shared import ship_package

# Fixed values ------------------------------------------------------------------------
ALGORITHM_VERSION = "logistic-baseline-v1"
FEATURES = ("market_score", "volatility_score", "gap_pct", "rvol", "spread_pct")
EPOCHS, LEARNING_RATE, L2 = 500, 0.05, 0.01
MINIMUM_SCALE = 1e-12
PROBABILITY_FLOOR = 1e-12
INELIGIBLE, MISSING_FEATURES, UNKNOWN_OUTCOME = (
    "ineligible",
    "missing_features",
    "unknown_outcome",
)
# -------------------------------------------------------------------------------------

KEY = ["snapshot_id", "symbol"]
FOLDS_PER_GROUP = 64


def exclusion_reason(features: Sequence[str] = FEATURES) -> Column:
    """Why a decision row cannot be used for the model, null when it can."""
    complete = F.lit(True)
    for name in features:
        complete = complete & is_finite(F.col(name))
    return (
        F.when(~F.coalesce(F.col("eligible"), F.lit(False)), INELIGIBLE)
        .when(~complete, MISSING_FEATURES)
        .when(F.col("net_return").isNull(), UNKNOWN_OUTCOME)
    )


def model_rows(
    decisions: DataFrame, outcomes: DataFrame, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Decision rows with their label (net return above zero) and exclusion reason."""
    joined = decisions.join(outcomes.select(*KEY, "net_return"), KEY, "left")
    return joined.select(
        *KEY,
        "session",
        *features,
        exclusion_reason(features).alias("excluded"),
        (F.col("net_return") > 0).cast("int").alias("label"),
    )


def walk_forward(rows: DataFrame, windows: ModelWindows, *, cut: int = SEGMENT_ROWS) -> DataFrame:
    """Assign chronologically ordered rows to every fold they belong to.

    Fold k starts at k * validation rows, so neighbouring folds overlap. A row joins at
    most ceil(total / validation) folds.
    """
    ordered = position(
        rows.withColumn("__all", F.lit(1)),
        ["__all"],
        [F.col("session").asc(), F.col("snapshot_id").asc(), F.col("symbol").asc()],
        along=rising_text(F.col("session").cast("string")),
        name="row",
        rows=cut,
    )
    total, step = windows.minimum_rows, windows.validation
    counted = ordered.withColumns(
        {"__n": rows.agg(F.count("*")).scalar(), "row": F.col("row") - 1}
    )
    folds = F.floor((F.col("__n") - total) / step) + 1
    first = F.greatest(F.lit(0), F.ceil((F.col("row") - total + 1) / step))
    last = F.least(folds - 1, F.floor(F.col("row") / step))
    assigned = counted.filter(F.col("__n") >= total).withColumns(
        {"__first": first, "__last": last}
    )
    exploded = (
        assigned.filter(F.col("__first") <= F.col("__last"))
        .withColumn("fold", F.explode(F.sequence("__first", "__last")))
        .drop("__first", "__last", "__n", "__all")
    )
    offset = F.col("row") - F.col("fold") * step
    return exploded.withColumn(
        "part",
        F.when(offset < windows.train, "train")
        .when(offset < windows.train + windows.validation, "validation")
        .otherwise("holdout"),
    )


def fit_logistic(
    x: np.ndarray, y: np.ndarray, *, epochs: int = EPOCHS, rate: float = LEARNING_RATE, l2: float = L2
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Full-batch gradient descent on standardised features; L2 spares the intercept.

    `x` is (folds, rows, features) and `y` (folds, rows): equally long training sets are
    fitted together, each on its own.
    """
    means = x.mean(axis=1, keepdims=True)
    scales = np.maximum(MINIMUM_SCALE, x.std(axis=1, keepdims=True))
    z = (x - means) / scales
    weights, intercept = np.zeros((x.shape[0], x.shape[2])), np.zeros((x.shape[0], 1))
    for _ in range(epochs):
        error = _logistic(intercept + np.einsum("krf,kf->kr", z, weights)) - y
        intercept -= rate * error.mean(axis=1, keepdims=True)
        gradient = np.einsum("krf,kr->kf", z, error) / y.shape[1]
        weights = weights - rate * (gradient + l2 * weights)
    return weights, intercept, means, scales


def _logistic(value: np.ndarray) -> np.ndarray:
    shrink = np.exp(-np.abs(value))
    return np.where(value >= 0, 1.0 / (1.0 + shrink), shrink / (1.0 + shrink))


def walk_forward_predictions(
    folds: DataFrame, windows: ModelWindows, features: Sequence[str] = FEATURES
) -> DataFrame:
    """Fit on each fold's training rows and score its later rows.

    Folds are independent and of fixed size; a group of at most FOLDS_PER_GROUP of them is
    fitted by one vectorised descent. The explicit partition count keeps this CPU-bound
    step spread over the cluster although its data is small.
    """
    names = list(features)
    total, train = windows.minimum_rows, windows.train

    def fit_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fold", "row"], kind="stable")
        count = len(rows) // total
        x = rows[names].to_numpy(float).reshape(count, total, len(names))
        y = rows["label"].to_numpy(float).reshape(count, total)
        weights, intercept, means, scales = fit_logistic(x[:, :train], y[:, :train])
        later = (x[:, train:] - means) / scales
        probability = _logistic(intercept + np.einsum("krf,kf->kr", later, weights))
        keep = np.tile(np.arange(total) >= train, count)
        out = rows.loc[keep, ["fold", "part", "row", "label"]].copy()
        out["probability"] = probability.reshape(-1)
        return out

    ship_package(folds.sparkSession)
    lean = folds.select("fold", "part", F.col("row").cast("long").alias("row"), "label", *names)
    partitions = int(folds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        lean.withColumn("__group", F.floor(F.col("fold") / FOLDS_PER_GROUP))
        .repartition(partitions, "__group")
        .groupBy("__group")
        .applyInPandas(
            fit_group, "fold long, part string, row long, label int, probability double"
        )
    )


def predict(intercept: float, weights: Sequence[float], means: Sequence[float],
            scales: Sequence[float], features: Sequence[str] = FEATURES) -> Column:
    """Probability as a column expression; null if any feature is missing or not finite."""
    score = F.lit(float(intercept))
    for name, weight, mean, scale in zip(features, weights, means, scales):
        value = F.when(is_finite(F.col(name)), F.col(name).cast("double"))
        score = score + (value - F.lit(float(mean))) / F.lit(float(scale)) * F.lit(float(weight))
    return sigmoid(score)


def binary_metrics(predictions: DataFrame, group: Sequence[str]) -> DataFrame:
    """Log loss (clipped), Brier score and accuracy at one half."""
    p, y = F.col("probability"), F.col("label").cast("double")
    safe = F.least(F.greatest(p, F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    return predictions.groupBy(*group).agg(
        F.count("*").alias("rows"),
        (-F.avg(y * F.log(safe) + (1 - y) * F.log(1 - safe))).alias("log_loss"),
        F.avg((p - y) * (p - y)).alias("brier"),
        F.avg(((p >= 0.5) == (y == 1)).cast("double")).alias("accuracy"),
    )


def exclusion_counts(rows: DataFrame, windows: ModelWindows | None = None) -> DataFrame:
    """One row: considered, used, excluded by reason, and whether there is enough data."""
    windows = windows or ModelWindows()
    used = F.count_if(F.col("excluded").isNull())
    return rows.agg(
        F.count("*").alias("rows_considered"),
        used.alias("rows_used"),
        *[
            F.count_if(F.col("excluded") == reason).alias(reason)
            for reason in (INELIGIBLE, MISSING_FEATURES, UNKNOWN_OUTCOME)
        ],
        F.when(used >= windows.minimum_rows, "READY").otherwise("INSUFFICIENT_DATA").alias("status"),
    )


def model_evidence(
    decisions: DataFrame,
    outcomes: DataFrame,
    windows: ModelWindows | None = None,
    features: Sequence[str] = FEATURES,
) -> tuple[DataFrame, DataFrame]:
    """Exclusion summary, and validation/holdout metrics per fold."""
    windows = windows or ModelWindows()
    rows = model_rows(decisions, outcomes, features)
    folds = walk_forward(rows.filter("excluded IS NULL").drop("excluded"), windows)
    metrics = binary_metrics(walk_forward_predictions(folds, windows, features), ["fold", "part"])
    return exclusion_counts(rows, windows), metrics


def fit_at_scale(rows: DataFrame, features: Sequence[str] = FEATURES):
    """The same model family through pyspark.ml, for training sets beyond one task.

    The optimizer converges instead of stopping after a fixed number of steps, so its
    coefficients differ from `fit_logistic`; compare metrics, not weights.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(features), outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
            LogisticRegression(
                featuresCol="scaled", labelCol="label", regParam=L2, standardization=False
            ),
        ]
    ).fit(rows)

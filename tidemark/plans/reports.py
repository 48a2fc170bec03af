"""Monthly research report: all parts keyed by month, and its dataset version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import model, research
from tidemark.operators.universe import content_digest, versioned_id
from tidemark.policies import ModelWindows


def dataset_versions(decisions: DataFrame) -> DataFrame:
    """`<month>-<12 hex>` from the content of the month's decision keys."""
    digests = content_digest(decisions, ["session", "snapshot_id", "symbol"], by=["month"])
    return digests.select(
        "month",
        F.col("digest").alias("manifest_hash"),
        versioned_id("", F.col("month"), F.col("digest")).alias("dataset_version"),
    )


def monthly_report(
    decisions: DataFrame,
    outcomes: DataFrame,
    month: str,
    *,
    cohort_rows: int = research.COHORT_ROWS,
    windows: ModelWindows | None = None,
) -> dict[str, DataFrame]:
    """The report's sections as DataFrames; nothing is collected.

    The month filter is pushed to the scans (partition pruning on a month-partitioned
    table).
    """
    rows = decisions.filter(F.col("month") == month)
    results = outcomes.filter(F.col("month") == month)
    activation, activation_metrics = research.activation_report(rows, results, cohort_rows)
    exclusions, folds = model.model_evidence(rows, results, windows)
    labels = research.regimes()
    return {
        "version": dataset_versions(rows),
        "quality": research.monthly_quality(rows, results, cohort_rows),
        "ablations": research.ablation_report(rows, results),
        "activation": activation,
        "activation_metrics": activation_metrics,
        "model_rows": exclusions,
        "model_folds": folds,
        "regimes": research.regime_breakdown(
            rows.select(*[expr.alias(name) for name, expr in labels.items()])
        ),
    }

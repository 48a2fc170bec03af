"""Universe build from catalog, daily bars, listing details and quotes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import universe
from tidemark.policies import UniversePolicy


def build_universe(
    assets: DataFrame,
    daily_bars: DataFrame,
    sessions: DataFrame,
    details: DataFrame,
    quotes: DataFrame,
    policy: UniversePolicy,
) -> tuple[DataFrame, DataFrame]:
    """Labelled candidates and the snapshot header (member count, digest, versioned id)."""
    metrics = universe.bar_metrics(daily_bars, sessions)
    candidates = universe.provider_candidates(assets, metrics, details, quotes, policy)
    rows = universe.select_universe(
        candidates.filter(universe.candidate_problem().isNull()), policy
    )
    digest = universe.content_digest(
        rows, ["symbol", "security_id", "exchange", "asset_type", "sector", "score", "reason"]
    )
    members = rows.agg(F.count_if("included").alias("members"), F.lit(1).alias("__one"))
    header = (
        digest.withColumn("__one", F.lit(1))
        .join(members, "__one")
        .drop("__one")
        .withColumn("complete", F.col("members") == policy.target)
    )
    return rows, header

"""Five-minute monitoring of selected symbols, as batch and as the stream's rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------------
BUCKET = "5 minutes"
# -------------------------------------------------------------------------------------

KEY = ["snapshot_id", "symbol"]
_OBSERVED = ["received_at", "last_trade_price", "bid_price", "ask_price", "volume"]


def bucket_start(at: Column) -> Column:
    return F.window(at, BUCKET).start


def best_selection(selections: DataFrame) -> DataFrame:
    """Best-ranked selection per (session, symbol)."""
    rest = [name for name in selections.columns if name not in ("session_date", "symbol")]
    return selections.groupBy("session_date", "symbol").agg(
        F.min_by(F.struct(*rest), F.struct("final_rank", "snapshot_id")).alias("__s")
    ).select("session_date", "symbol", "__s.*")


def selected_quotes(quotes: DataFrame, selections: DataFrame) -> DataFrame:
    """Quotes of selected symbols (works for a stream joined to a static table too)."""
    return quotes.join(selections, ["session_date", "symbol"])


def first_in_bucket(joined: DataFrame, tie_break: str = "event_id") -> DataFrame:
    """The first observation of each bucket; later ones in the bucket are dropped."""
    row = F.struct(*_OBSERVED, tie_break, "decision_price", "stop", "target", "role")
    return (
        joined.groupBy(*KEY, F.window("received_at", BUCKET).alias("bucket"))
        .agg(F.min_by(row, F.struct("received_at", tie_break)).alias("__r"))
        .select(*KEY, F.col("bucket.start").alias("bucket_at"), "__r.*")
    )


def with_return(buckets: DataFrame) -> DataFrame:
    price, decided = F.col("last_trade_price"), F.col("decision_price")
    return buckets.withColumns(
        {
            "return_pct": F.when((price > 0) & (decided > 0), (price / decided - 1) * 100),
            "target_hit": F.coalesce(price >= F.col("target"), F.lit(False)),
            "stop_hit": F.coalesce(price <= F.col("stop"), F.lit(False)),
        }
    )


def monitor(quotes: DataFrame, selections: DataFrame) -> DataFrame:
    """Kept observations with running favourable and adverse extremes.

    After the bucket step a selection has at most 288 rows a day, so its running window is
    bounded.
    """
    kept = with_return(
        first_in_bucket(selected_quotes(quotes, best_selection(selections)))
    )
    w = (
        Window.partitionBy(*KEY).orderBy("bucket_at").rowsBetween(Window.unboundedPreceding, 0)
    )
    zero = F.lit(0.0)
    return kept.withColumns(
        {
            "mfe_pct": F.greatest(zero, F.max("return_pct").over(w)),
            "mae_pct": F.least(zero, F.min("return_pct").over(w)),
        }
    )

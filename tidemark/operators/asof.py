"""As-of joins as one shuffle: union both sides and carry the latest value forward.

Keys with very many rows are cut into segments (`segments`); the value that is open at the start of
a segment is carried into it, one row each. Both sides are read once for the join and, unless the
caller gives the cuts, once for counting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.segments import KeyedSeries, Segmentation


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    direction: str = "backward",
    segmentation: Segmentation | None = None,
) -> DataFrame:
    """Attach to each left row the right row closest in time in one direction.

    Equal times match. `values` (and `right_time`) come from the right side and must not
    clash with left columns; without a match they are null. If the right side repeats a
    time, the row with the greatest values is used.
    """
    if direction not in {"backward", "forward"}:
        raise ValueError("direction must be backward or forward")
    sign = 1 if direction == "backward" else -1
    payload = F.struct(F.col(right_time), *[F.col(name) for name in values])

    def ordered(frame: DataFrame, time: str) -> Column:
        return (F.unix_micros(F.col(time).cast("timestamp")) * sign).cast("long")

    needles = left.withColumn("__o", ordered(left, left_time))
    # Rows of one time are ordered by their values, so the greatest of them is the last one.
    lookup = right.filter(F.col(right_time).isNotNull()).select(
        *by, ordered(right, right_time).alias("__o"), payload.alias("__match")
    )
    both = lookup.withColumn("__side", F.lit(0)).unionByName(
        needles.withColumn("__side", F.lit(1)), allowMissingColumns=True
    )
    if segmentation is None:
        times = lookup.select(*by, "__o").unionByName(needles.select(*by, "__o"))
        segmentation = Segmentation.for_input(times, by, F.col("__o"))
    series = KeyedSeries(both, by, ["__o", "__side", "__match"], segmentation)
    series.accumulate(lasts={"__found": F.when(F.col("__side") == 0, F.col("__match"))})
    matched = series.finish().filter(F.col("__side") == 1)
    return matched.select(
        *left.columns,
        F.col("__found").getField(right_time).alias(right_time),
        *[F.col("__found").getField(name).alias(name) for name in values],
    )

"""Helpers that keep plans small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settle(df: DataFrame, *names: str) -> DataFrame:
    """Compute `names` once, here.

    The optimizer copies the defining expression of a column into every filter above it; for
    deep score and gate expressions that grows the plan past what can be compiled. Passing
    the finished values through a one-element `inline` keeps filters above them without a
    shuffle and without leaving generated code.
    """
    others = [name for name in df.columns if name not in names]
    return df.select(*others, F.inline(F.array(F.struct(*names))))

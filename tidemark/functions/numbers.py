"""Numeric column helpers: clipping, safe parsing, safe division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clip to [low, high]; null stays null."""
    return F.when(
        value.isNotNull(), F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))
    )


def clip_known(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Clip a value that is never null (a null would become `low`)."""
    return F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high)))


def finite(value: Column) -> Column:
    """The value as double, with NaN and infinities turned into null."""
    number = value.cast("double")
    return F.when(
        ~F.isnan(number)
        & (number != F.lit(float("inf")))
        & (number != F.lit(float("-inf"))),
        number,
    )


def is_finite(value: Column) -> Column:
    return finite(value).isNotNull()


def parse_number(text: Column) -> Column:
    """Finite double from text, null for anything else."""
    return finite(text.try_cast("double"))


def parse_unit(text: Column, default: Column | float) -> Column:
    """A number clipped to [0, 1]; missing or unusable text gives the default unclipped."""
    fallback = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(clip(parse_number(text)), fallback)


def positive(value: Column) -> Column:
    """The value when it is above zero, else null (a safe denominator)."""
    return F.when(value > 0, value)


def sortable(text: Column) -> Column:
    """Scores that cannot be read or are not finite sort last."""
    return F.coalesce(parse_number(text), F.lit(float("-inf")))


def sigmoid(value: Column) -> Column:
    """Logistic function that never exponentiates a positive number."""
    shrink = F.exp(-F.abs(value))
    return F.when(value >= 0, 1.0 / (1.0 + shrink)).otherwise(shrink / (1.0 + shrink))

"""Title normalisation, dedupe keys, headline polarity, cashtags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values ------------------------------------------------------------------------
POSITIVE_WORDS = (
    "beat", "beats", "breakout", "breakouts", "growth", "gain", "gains", "higher", "profit",
    "profits", "record", "strong", "surge", "surges", "upgrade",
)
NEGATIVE_WORDS = (
    "cut", "cuts", "decline", "declines", "downgrade", "fall", "falls", "fraud", "loss",
    "losses", "miss", "misses", "probe", "weak",
)
# -------------------------------------------------------------------------------------


def fold(text: Column) -> Column:
    """Lower case with the one folding lower() leaves out that titles use."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def normalized_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(fold(title), r"[^\p{L}\p{N}]+", " "))


def dedupe_key() -> Column:
    """News: UTC day and normalised title (else url, else id). Others: provider and id."""
    title = F.coalesce(
        F.nullif(normalized_title(F.col("title")), F.lit("")), F.col("url"), F.col("external_id")
    )
    day = F.date_format("source_at", "yyyy-MM-dd")
    basis = F.when(F.col("kind") == "news", F.concat_ws(":", day, title)).otherwise(
        F.concat_ws(":", "provider", "external_id")
    )
    return F.sha2(basis, 256)


def normalized_symbols(symbols: Column) -> Column:
    cleaned = F.transform(symbols, lambda s: F.upper(F.trim(s)))
    return F.array_distinct(F.filter(cleaned, lambda s: s != ""))


def headline_direction(
    title: Column,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
) -> Column:
    """+1 / -1 by the distinct polar words of a title, null on a tie."""
    # Every Unicode blank parts words; a word counts once.
    words = F.split(F.regexp_replace(fold(title), r"(?U)[^\p{L}\p{N}\s]+", ""), r"(?U)\s+")

    def hits(lexicon: Sequence[str]) -> Column:
        return F.size(F.array_intersect(words, F.array(*[F.lit(word) for word in lexicon])))

    balance = hits(positive) - hits(negative)
    return F.when(balance > 0, F.lit(1.0)).when(balance < 0, F.lit(-1.0))


def cashtags(title: Column, allowed: Sequence[str]) -> Column:
    """Upper-cased $TICKER mentions that are in the allowed list, in order, once each."""
    found = F.transform(F.regexp_extract_all(title, F.lit(r"\$([A-Za-z]{1,5})\b"), F.lit(1)), F.upper)
    return F.array_distinct(F.array_intersect(found, F.array(*[F.lit(s.upper()) for s in allowed])))

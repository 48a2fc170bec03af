"""Named queries over the driver tables, each with the SQL it must equal."""

from tidemark.registry.core import ORACLES, QUERIES

from tidemark.registry import (  # noqa: F401  (imported for registration)
    evidence,
    markets,
    prices,
    selection,
    studies,
    trading,
)

__all__ = ["ORACLES", "QUERIES"]

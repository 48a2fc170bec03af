"""Registration of queries and composition of their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_view(name: str, body: str, *needs: str) -> None:
    """A common table expression oracles may use, with the ones it needs."""
    _VIEWS[name] = (needs, body.strip())


def _with(names: tuple[str, ...]) -> list[str]:
    ordered: list[str] = []

    def visit(name: str) -> None:
        needs, _ = _VIEWS[name]
        for other in needs:
            visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return ordered


def oracle(body: str, *views: str) -> str:
    names = _with(views)
    if not names:
        return body.strip()
    parts = ",\n".join(f"{name} AS (\n{_VIEWS[name][1]}\n)" for name in names)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {parts},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {parts},\n{text[5:]}"
    return f"WITH {parts}\n{text}"


def query(name: str, sql: str | None = None, *views: str):
    """Register `(spark, folder) -> DataFrame` under a name, with its oracle if it has one."""

    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = oracle(sql, *views)
        return function

    return add

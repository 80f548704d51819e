"""Gates: each returns the problems that it finds, none if all is well."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def has_rows(**tables: DataFrame) -> list[str]:
    return [f"{name} is empty" for name, df in tables.items() if df.isEmpty()]


def has_columns(df: DataFrame, *names: str) -> list[str]:
    return [f"{n} is missing" for n in names if n not in df.columns]


def at_least(df: DataFrame, column: str, least: float) -> list[str]:
    """The one value of a one-row table against a threshold."""
    value = df.first()[column]
    return [] if value is not None and value >= least else [f"{column} is {value}, wanted {least}"]


def no_duplicates(df: DataFrame, *keys: str) -> list[str]:
    n = df.groupBy(*keys).count().filter("count > 1").count()
    return [f"{n} keys of {', '.join(keys)} are not unique"] if n else []


def covers(stored: DataFrame, wanted: DataFrame, *keys: str) -> list[str]:
    """Whether every key of wanted is stored."""
    n = wanted.select(*keys).distinct().join(stored.select(*keys), list(keys), "left_anti").count()
    return [f"{n} rows are not stored"] if n else []


def replays_are_duplicates(outcomes: DataFrame) -> list[str]:
    """A second ingest of the same events must give nothing but duplicates."""
    n = outcomes.filter(F.col("outcome") == "done").count()
    return [f"{n} replayed events were taken as new"] if n else []


def services_are_up(report: dict) -> list[str]:
    return [f"{k} is {v}" for k, v in sorted((report.get("services") or {}).items()) if v not in ("ok", True)]

"""The severity ladder, risk weights and score bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranks and weights by severity; whatever is not listed counts as 0.
RANKS = {"info": 0, "low": 1, "medium": 2, "high": 3, "critical": 4}
WEIGHTS = {"low": 1, "medium": 2, "high": 4, "critical": 8}
# Least change score of a severity.
HIGH_CHANGE, MEDIUM_CHANGE = 0.05, 0.01


def _lookup(severity: Column, values: dict[str, int]) -> Column:
    cases = reduce(lambda c, kv: c.when(severity == kv[0], F.lit(kv[1])), values.items(), F.when(severity.isNull(), F.lit(0)))
    return cases.otherwise(F.lit(0))


def rank(severity: Column) -> Column:
    """Rank of a severity; unknown and null rank 0."""
    return _lookup(severity, RANKS)


def weight(severity: Column) -> Column:
    """Risk weight of a severity; info, unknown and null weigh 0."""
    return _lookup(severity, WEIGHTS)


def of_change(score: Column) -> Column:
    """Severity of a change score."""
    return F.when(score >= HIGH_CHANGE, "high").when(score >= MEDIUM_CHANGE, "medium").otherwise("low")

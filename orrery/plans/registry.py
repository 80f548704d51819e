"""Queries over the driver's tables and their SQL twins, gathered from the domains."""

from __future__ import annotations

from orrery.plans import alerts, evidence, files, more, retrieval, series, state

PARTS = (alerts, evidence, retrieval, series, more, files, state)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}

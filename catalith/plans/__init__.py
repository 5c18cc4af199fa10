"""Registered queries over the driver's tables, each with its SQL for DuckDB."""

from __future__ import annotations

from catalith.plans import catalog, engine, requests

QUERIES = catalog.QUERIES | engine.QUERIES | requests.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL | engine.ORACLE_SQL | requests.ORACLE_SQL

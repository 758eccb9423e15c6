"""Registered queries: each with the SQL that must give the same rows."""

from wardlog.catalog import (  # noqa: F401
    aggregates,
    detectors,
    features,
    filters,
    joins,
    models,
    ordering,
    scalars,
    scans,
    scoring,
    streams,
)
from wardlog.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

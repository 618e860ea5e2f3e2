"""Registered queries and their SQL, by kind of operator."""

from . import aggregates, joins, models, projections, scalars, scans, search, streams, texts, windows  # noqa: F401
from .registry import ORACLES, QUERIES

FLAGSHIP = "ret_hybrid_recommendation"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]

"""All queries of the engine's own operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from .plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

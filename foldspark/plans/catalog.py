"""All registered queries of the engine."""

from __future__ import annotations

from foldspark.plans import dataset, relational, science, sequences  # noqa: F401
from foldspark.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]

"""All queries of the core."""

from __future__ import annotations

from lexiloom.plans import catalogue, evaluation, loader, small, sources  # noqa: F401
from lexiloom.plans.registry import ORACLES, QUERIES, ship

__all__ = ["ORACLES", "QUERIES", "ship"]

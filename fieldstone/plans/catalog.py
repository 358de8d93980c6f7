"""All queries of the library, from the modules that register them."""

from __future__ import annotations

from . import control_queries, link_queries, opportunity_queries, planning_queries, review_queries, rule_queries, source_queries, state_queries, valuation_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

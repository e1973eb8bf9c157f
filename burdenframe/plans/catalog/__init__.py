"""Registered queries: every operator over the star-schema cohort, with oracle SQL."""

from burdenframe.plans.catalog import burden_queries, resample_queries, source_queries, stat_queries  # noqa: F401
from burdenframe.plans.catalog.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]

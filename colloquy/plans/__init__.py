"""Runnable queries over the test tables, each with its oracle SQL."""

from colloquy.plans import views  # noqa: F401  (defines the oracle views first)
from colloquy.plans import (  # noqa: F401
    ingest_queries,
    statistics_queries,
    evaluation_queries,
    claim_queries,
    refresh_queries,
    containment_queries,
)
from colloquy.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

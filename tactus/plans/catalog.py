"""Importing this module registers every query."""

from tactus.plans import (  # noqa: F401
    audit_queries,
    corpus_queries,
    folder_queries,
    grid_queries,
    live_queries,
    play_queries,
    series_queries,
    source_queries,
    timing_queries,
)
from tactus.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

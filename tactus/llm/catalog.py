"""The queries of this subpackage and the SQL that they are checked with."""

from __future__ import annotations

import corpus_pipeline
from tactus.llm import queries  # noqa: F401
from tactus.llm.registry import ORACLES, QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["ORACLES", "QUERIES"]

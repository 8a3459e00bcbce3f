"""All queries of the variant engine, and their SQL."""

from __future__ import annotations

from strandmill.plans import annotate_queries, evidence_queries, frame_queries, text_queries  # noqa: F401
from strandmill.plans.oracles import ORACLES
from strandmill.plans.queries import QUERIES

__all__ = ["ORACLES", "QUERIES"]

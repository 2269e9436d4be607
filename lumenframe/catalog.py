"""All registered queries of the engine and the SQL each equals."""

from __future__ import annotations

from .queries import agents, dialogue, evaluation, relational, retrieval, temporal, texts, tools  # noqa: F401  they register themselves
from .queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""The queries of the library and their SQL, gathered from the modules of ``plans``."""

from __future__ import annotations

from lodeline.plans import answering, knowledge, learning, pages, reporting, routing, search, sourcing, texts, web  # noqa: F401 - they register their queries
from lodeline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

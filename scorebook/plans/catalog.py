"""All registered queries."""

from __future__ import annotations

from scorebook.plans import (  # noqa: F401  (importing registers)
    feature_queries,
    lineup_queries,
    model_queries,
    page_queries,
    stream_queries,
    table_queries,
    text_queries,
)
from scorebook.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

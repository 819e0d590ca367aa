"""All registered queries."""

from __future__ import annotations

from . import feature_queries, post_queries, price_queries, table_queries, text_queries  # noqa: F401, I001
from . import source_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

"""All registered queries of the analytics engine."""

from __future__ import annotations

from . import comparison_queries, detect_queries, forecast_queries, join_queries, panel_queries, source_queries, workbook_queries, stream_queries, text_queries, view_queries  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

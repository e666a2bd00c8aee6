"""All registered queries."""

from __future__ import annotations

import importlib

MODULES = (
    "calendar_queries", "aggregate_queries", "window_queries", "filter_queries", "join_queries",
    "set_queries", "scalar_queries", "quality_queries", "source_queries", "panel_queries",
    "alignment_queries", "stream_queries", "series_queries",
)


def load() -> None:
    for name in MODULES:
        importlib.import_module(f"periodica.catalog.{name}")

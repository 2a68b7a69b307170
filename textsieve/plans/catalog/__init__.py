"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import CATALOG, Query

_MODULES = [
    "text_queries", "filter_queries", "join_queries", "aggregate_queries", "window_queries", "set_queries",
    "vector_queries", "number_queries", "evaluation_queries", "source_queries", "page_queries", "model_queries",
]


def all_queries() -> dict[str, Query]:
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    return dict(CATALOG)

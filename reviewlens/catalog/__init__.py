"""Named queries over the shared test tables, with their checking SQL."""

from __future__ import annotations

import importlib

from reviewlens.catalog.registry import CHECKS, QUERIES

MODULES = ("profile_queries", "text_queries", "vector_queries", "feed_queries", "model_queries", "store_queries")


def load_catalog():
    for name in MODULES:
        importlib.import_module(f"reviewlens.catalog.{name}")
    return QUERIES, CHECKS

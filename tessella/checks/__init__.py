"""Registered queries with their equivalent SQL."""

from __future__ import annotations

import importlib

from tessella.checks.registry import ORACLE, QUERIES

MODULES = ["tiles", "volumes", "scalars", "pairing", "roi", "stencils", "patches", "saliency", "sampling", "scoring", "loop", "ingest", "configs"]


def load() -> tuple[dict, dict]:
    """Import every check module and return the two registries."""
    for name in MODULES:
        importlib.import_module(f"tessella.checks.{name}")
    return QUERIES, ORACLE

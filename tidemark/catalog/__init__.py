"""Registered queries and their SQL twins over the given tables."""

from __future__ import annotations

from importlib import import_module

from tidemark.catalog.registry import CASES, Case

MODULES = ("ingest", "daily", "monthly", "study")


def load() -> dict[str, Case]:
    """Every registered query by name."""
    for module in MODULES:
        import_module(f"tidemark.catalog.{module}")
    return CASES

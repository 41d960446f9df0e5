"""All core queries and their SQL, gathered from the modules of this package."""

from __future__ import annotations

import importlib

MODULES = ["lines", "text", "audit", "layers", "chunking", "repairs", "vectors", "packages", "jobs", "regions", "pipeline"]


def _gather(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(getattr(importlib.import_module(f"tessera.plans.{name}"), attribute))
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")

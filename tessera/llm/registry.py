"""All queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
import pkgutil

import tessera.llm as package


def _gather(attribute: str) -> dict:
    found: dict = {}
    for module in sorted(pkgutil.iter_modules(package.__path__), key=lambda m: m.name):
        if module.name.startswith("queries_"):
            found.update(getattr(importlib.import_module(f"tessera.llm.{module.name}"), attribute, {}))
    return found


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("SQL")

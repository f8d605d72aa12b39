"""SQL twins of the registered queries, for an in-process DuckDB check."""

from __future__ import annotations

import importlib
import pkgutil


def all_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in pkgutil.iter_modules(__path__):
        out.update(getattr(importlib.import_module(f"{__name__}.{module.name}"), "SQL", {}))
    return out

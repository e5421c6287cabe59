"""The registered queries and their SQL counterparts, by module."""

from __future__ import annotations

import importlib
import pkgutil


def _modules():
    for m in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        yield importlib.import_module(f"{__name__}.{m.name}")


def all_queries() -> dict:
    return {k: q for m in _modules() for k, q in getattr(m, "QUERIES", {}).items()}


def all_oracles() -> dict:
    return {k: q for m in _modules() for k, q in getattr(m, "ORACLE", {}).items()}

"""Loads every query module and hands out the registry."""

from __future__ import annotations

import importlib
import pkgutil

from sparktraces.plans import queries
from sparktraces.plans.registry import REGISTRY, Query


def load() -> dict[str, Query]:
    for module in sorted(m.name for m in pkgutil.iter_modules(queries.__path__)):
        importlib.import_module(f"{queries.__name__}.{module}")
    return REGISTRY

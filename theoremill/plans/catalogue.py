"""All queries of the core, gathered from the modules of this package."""

from __future__ import annotations

import importlib
import pkgutil

import theoremill.plans as package

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

for _info in sorted(pkgutil.iter_modules(package.__path__), key=lambda m: m.name):
    if _info.name != "catalogue":
        _module = importlib.import_module(f"{package.__name__}.{_info.name}")
        QUERIES |= getattr(_module, "QUERIES", {})
        ORACLES |= getattr(_module, "ORACLES", {})

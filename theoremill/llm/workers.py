"""Objects that a Python worker builds once, however many tasks it runs."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

_built: dict[str, Any] = {}


def once(name: str, build: Callable[[], Any]) -> Any:
    """What ``build`` made under ``name`` in this worker; the last two names are kept."""
    if name not in _built:
        while len(_built) > 1:
            _built.pop(next(iter(_built)))
        _built[name] = build()
    return _built[name]

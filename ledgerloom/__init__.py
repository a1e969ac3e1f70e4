"""A PySpark engine for sets of SQL change scripts; see README.md."""

from __future__ import annotations

from importlib import import_module

VERSION = "0.2.0"
#: What the library offers to others, and where it lies; loaded when it is asked for.
_PUBLIC = {"Config": "config", "Naming": "functions.naming", "Manifest": "sources.manifest", "Ledger": "sources.ledger", "Rule": "plans.lint", "Project": "plans.project"}
__all__ = ["VERSION", *_PUBLIC]


def __getattr__(name: str) -> object:
    if name not in _PUBLIC:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_PUBLIC[name]}"), name)

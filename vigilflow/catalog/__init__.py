"""Registered queries: one module per part of the inventory, each with its checking SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("rows", "windows", "state", "dash", "memory", "io", "streams")


def _all(attribute: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"{__name__}.{name}"), attribute)
        clash = out.keys() & part.keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        out.update(part)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict:
    return _all("ORACLE")

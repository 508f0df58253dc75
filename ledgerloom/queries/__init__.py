"""The driver's queries by family; each module has QUERIES (name: function of spark and folder) and ORACLES (name: SQL)."""

from __future__ import annotations

import importlib

FAMILIES = ("ledgers", "texts", "headers", "layouts", "validation", "accounts")


def _all(what: str) -> dict:
    out: dict = {}
    for family in FAMILIES:
        out |= getattr(importlib.import_module(f"{__package__}.{family}"), what)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("ORACLES")

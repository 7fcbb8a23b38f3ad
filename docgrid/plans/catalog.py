"""The registered queries of the engine and their SQL equivalents."""

from __future__ import annotations

from importlib import import_module

MODULES = ("retrieval", "governance", "sections", "hierarchy", "tables", "ledger", "rules", "sources", "policies", "providers", "outputs")


def _all(name: str) -> dict:
    found: dict = {}
    for m in MODULES:
        found |= getattr(import_module(f"docgrid.plans.{m}"), name)
    return found


def queries() -> dict:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")

"""All registered queries and their oracle SQL."""

from __future__ import annotations

import importlib

MODULES = (
    "queries_sales", "queries_cleaning", "queries_features", "queries_supply", "queries_evaluation",
    "queries_stats", "queries_models",
)


def _merged(attribute: str) -> dict:
    found: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"demandloom.plans.{name}")
        clash = found.keys() & getattr(module, attribute).keys()
        if clash:
            raise ValueError(f"registered twice: {sorted(clash)}")
        found |= getattr(module, attribute)
    return found


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")

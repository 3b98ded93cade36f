"""Registered queries, each wired to the driver's tables, with its SQL twin."""

from __future__ import annotations

from importlib import import_module

from uttermark.plans.registry import ORACLES, QUERIES

MODULES = (
    "sources",
    "text",
    "filters",
    "joins",
    "similarity",
    "aggregates",
    "evaluation",
    "diagnostics",
    "selection",
    "sampling",
    "generation",
    "bio",
    "classify",
)

for _m in MODULES:
    import_module(f"uttermark.plans.{_m}")

__all__ = ["ORACLES", "QUERIES"]

"""Registered queries, each with the SQL that states the same result."""

from __future__ import annotations

import importlib

MODULES = ("series", "stats", "windows", "limits", "detect", "pairs", "consensus", "clusters", "causal", "report", "models", "rolling", "streams")


def load() -> None:
    for name in MODULES:
        try:
            importlib.import_module(f"catalog.{name}")
        except ModuleNotFoundError as err:
            if err.name != f"catalog.{name}":
                raise

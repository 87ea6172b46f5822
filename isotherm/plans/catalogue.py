"""Imports every module that registers queries."""

from __future__ import annotations

from importlib import import_module

MODULES = ("sources", "columns", "spatial", "joins", "climatology", "evaluation", "traffic", "streams", "details")


def load() -> None:
    for module in MODULES:
        import_module(f"isotherm.plans.{module}")

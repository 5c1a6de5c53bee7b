"""Registered queries of the library over the driver tables."""

from __future__ import annotations

import importlib


def load():
    """Import every query module and return the filled registry."""
    from returnlens.catalog import registry

    for name in MODULES:
        importlib.import_module(f"returnlens.catalog.{name}")
    return registry


MODULES = ["steps", "core", "runs", "ingest", "jobs"]

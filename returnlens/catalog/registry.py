"""Registered queries: a DataFrame builder over panels and, where SQL can say the same, its oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from returnlens.catalog.panels import Panels, with_panels

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
STEPS: dict[str, str] = {}
#: Steps that replace the shared ones in the oracle text of one query, where it alters its inputs.
ALTERED: dict[str, dict[str, str]] = {}


def query(name: str, sql: str | None = None, steps: dict[str, str] | None = None):
    def register(build: Callable[[Panels], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Panels(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
            ALTERED[name] = steps or {}
        return build

    return register


def oracle_texts() -> dict[str, str]:
    return {name: with_panels(sql, STEPS | ALTERED[name]) for name, sql in ORACLES.items()}

"""Keyed merges of incoming rows into stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.operators.pit import top_rows


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    key: list[str],
    newest: list[Column],
    keep: list[str] | None = None,
) -> DataFrame:
    """Stored rows with incoming ones written over them on ``key``.

    Several incoming rows of one key reduce to the first by ``newest``. Columns in ``keep`` (surrogate ids) survive
    from the stored row on a conflict.
    """
    fresh = top_rows(incoming, key, newest)
    kept = keep or []
    if kept:
        old = existing.select(*key, *[F.col(c).alias(f"_old_{c}") for c in kept])
        fresh = fresh.join(old, key, "left").select(
            *[F.coalesce(f"_old_{c}", c).alias(c) if c in kept else F.col(c) for c in existing.columns]
        )
    untouched = existing.join(fresh.select(*key), key, "left_anti")
    return untouched.select(*existing.columns).unionByName(fresh.select(*existing.columns))


def insert_absent(existing: DataFrame, incoming: DataFrame, key: list[str], newest: list[Column]) -> DataFrame:
    """Stored rows plus incoming rows whose key is not stored yet."""
    fresh = top_rows(incoming, key, newest).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def replace_children(existing: DataFrame, incoming: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Drop every stored child of the written parents, then add the new children."""
    others = existing.join(parents.select(key).distinct(), key, "left_anti")
    return others.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def store_results(
    stored_runs: DataFrame, stored_parts: DataFrame, new_runs: DataFrame, new_parts: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Upsert runs on their deterministic id and replace the contributions of every run written."""
    runs = upsert(stored_runs, new_runs, ["attribution_run_id"], [F.col("created_at").desc()])
    parts = replace_children(stored_parts, new_parts, new_runs, "attribution_run_id")
    return runs, parts

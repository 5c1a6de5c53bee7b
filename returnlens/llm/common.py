"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own limit for a broadcast is far higher; nothing here is broadcast beyond this many rows.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column, parts: int) -> Column:
    """``crc32(key as text) mod parts``; null where the key is null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast where counting proves that ``df`` stays under ``rows`` rows; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def sample_fraction(total: int, bound: int) -> float:
    return 1.0 if total <= bound else bound / total


def in_sample(key: Column, fraction: Column | float) -> Column:
    """Keep about ``fraction`` of the keys, always the same ones."""
    share = F.pmod(F.xxhash64(key), F.lit(1_000_000)) / F.lit(1_000_000.0)
    return share < fraction


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for the jobs run inside, where long texts would make the usual ones heavy."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)

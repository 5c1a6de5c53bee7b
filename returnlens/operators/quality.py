"""Checks whose result must be empty, and rows for rejected input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnlens.functions.parsing import utc_timestamp
from returnlens.operators.assemble import driver_rank
from returnlens.vocab import DRIVER_RANK, RESIDUAL_DRIVER

PIT_COLUMNS = ["event_time", "ingestion_time", "timestamp_available"]


def reconciliation_breaks(run_rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Runs whose rows miss the observed return by over 1 bp, lack a single residual, or disagree with its field."""
    is_residual = F.col("driver") == RESIDUAL_DRIVER
    sums = parts.groupBy("attribution_run_id").agg(
        F.sum("contribution_bps").alias("total_bps"),
        F.count_if(is_residual).alias("residual_rows"),
        F.sum(F.when(is_residual, F.col("contribution_bps"))).alias("residual_bps"),
    )
    checked = run_rows.join(sums, "attribution_run_id", "left")
    gap = F.abs(F.coalesce("total_bps", F.lit(0.0)) - F.col("observed_return_bps"))
    residual_gap = F.abs(F.col("residual_bps") - F.col("unexplained_residual_bps"))
    problem = (
        F.when(gap > 1.0, "does not reconcile")
        .when(F.coalesce("residual_rows", F.lit(0)) != 1, "needs exactly one residual row")
        .when(residual_gap > 1e-9, "residual field differs")
    )
    return checked.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        "attribution_run_id", "problem", "total_bps", "residual_rows"
    )


def lookahead_breaks(run_rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Contributions whose payload names an availability after their run's cutoff."""
    stated = utc_timestamp(F.get_json_object("evidence_payload", "$.timestamp_available"))
    cutoffs = run_rows.select("attribution_run_id", "attribution_cutoff")
    return (
        parts.withColumn("stated_available", stated)
        .where(F.col("stated_available").isNotNull())
        .join(cutoffs, "attribution_run_id")
        .where(F.col("stated_available") > F.col("attribution_cutoff"))
        .select("attribution_run_id", "driver", "name", "stated_available", "attribution_cutoff")
    )


def driver_order_breaks(parts: DataFrame) -> DataFrame:
    """Rows with a driver outside the known order, which could not be placed before or after events."""
    known = F.create_map(*[F.lit(p) for pair in DRIVER_RANK.items() for p in pair])
    return parts.where(F.try_element_at(known, F.col("driver")).isNull())


def systematic_order_breaks(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a systematic driver that stand after an event row of their run; ``placed`` has a ``position``."""
    first_event = F.min(F.when(F.col("driver") == "event", F.col("position"))).over(Window.partitionBy(*keys))
    systematic = driver_rank(F.col("driver")) < DRIVER_RANK["event"]
    return placed.withColumn("first_event", first_event).where(systematic & (F.col("position") > F.col("first_event")))


def sorted_positions(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Position of each row inside its run: by driver order, then name."""
    rank = driver_rank(F.col("driver"))
    w = Window.partitionBy(*keys).orderBy(rank, "name", "contribution_bps")
    return parts.withColumn("position", F.row_number().over(w))


def missing_pit_columns(df: DataFrame) -> list[str]:
    return [c for c in PIT_COLUMNS if c not in df.columns]


def issues(rows: DataFrame, severity: str, issue_type: str, source_table: str, key: Column, details: Column) -> DataFrame:
    return rows.select(
        F.lit(severity).alias("severity"),
        F.lit(issue_type).alias("issue_type"),
        F.lit(source_table).alias("source_table"),
        key.cast("string").alias("source_key"),
        details.alias("details"),
    )

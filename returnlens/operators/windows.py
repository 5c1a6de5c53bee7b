"""Attribution windows: generation, validity, resume and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.operators.pit import top_rows
from returnlens.operators.returns import by_security, move_bps
from returnlens.vocab import CADENCES

WINDOW = ["security_id", "cadence", "window_start", "window_end"]


def build_windows(bars: DataFrame, cadences: list[str] = CADENCES) -> DataFrame:
    """Daily pairs of neighbouring bars; ISO weeks and calendar months from first to last bar inside them.

    The closes at both ends travel along, so the observed return needs no further lookup.
    """
    unknown = set(cadences) - set(CADENCES)
    if unknown:
        raise ValueError(f"unknown cadence {sorted(unknown)}")
    parts = []
    if "daily" in cadences:
        w = by_security()
        parts.append(
            bars.select(
                "security_id",
                F.lit("daily").alias("cadence"),
                F.lag("event_date").over(w).alias("window_start"),
                F.col("event_date").alias("window_end"),
                F.lag("adjusted_close").over(w).alias("start_close"),
                F.col("adjusted_close").alias("end_close"),
            ).where(F.col("window_start").isNotNull())
        )
    periods = {"weekly": F.trunc("event_date", "week"), "monthly": F.trunc("event_date", "month")}
    for cadence in ("weekly", "monthly"):
        if cadence in cadences:
            parts.append(
                bars.groupBy("security_id", periods[cadence].alias("period"))
                .agg(
                    F.min("event_date").alias("window_start"),
                    F.max("event_date").alias("window_end"),
                    F.min_by("adjusted_close", "event_date").alias("start_close"),
                    F.max_by("adjusted_close", "event_date").alias("end_close"),
                )
                .where(F.col("window_end") > F.col("window_start"))
                .select(
                    "security_id",
                    F.lit(cadence).alias("cadence"),
                    "window_start",
                    "window_end",
                    "start_close",
                    "end_close",
                )
            )
    return reduce(DataFrame.unionByName, parts)


def with_observed_return(windows: DataFrame) -> DataFrame:
    return windows.withColumn("observed_return_bps", move_bps(F.col("end_close"), F.col("start_close")))


def with_history(windows: DataFrame, coverage: DataFrame, lookback_days: int) -> DataFrame:
    """Windows whose whole lookback lies after the security's first price."""
    first = coverage.select("security_id", "first_price_date")
    earliest = F.date_add("first_price_date", lookback_days)
    return windows.join(first, "security_id").where(F.col("window_start") >= earliest).drop("first_price_date")


def from_analysis_start(windows: DataFrame, start: str | Column) -> DataFrame:
    return windows.where(F.col("window_start") >= (F.lit(start).cast("date") if isinstance(start, str) else start))


def after_checkpoint(windows: DataFrame, runs: DataFrame) -> DataFrame:
    """Windows ending after the last one stored for the same security and cadence."""
    done = runs.groupBy("security_id", "cadence").agg(F.max("window_end").alias("last_end"))
    return (
        windows.join(done, ["security_id", "cadence"], "left")
        .where(F.col("last_end").isNull() | (F.col("window_end") > F.col("last_end")))
        .drop("last_end")
    )


def first_windows(windows: DataFrame, n: int) -> DataFrame:
    return top_rows(windows, ["security_id", "cadence"], [F.col("window_start").asc()], n)


def not_yet_run(windows: DataFrame, runs: DataFrame, model_version: str, basket_version: str) -> DataFrame:
    done = runs.where(
        (F.col("model_version") == model_version) & (F.col("factor_basket_version") == basket_version)
    ).select(*WINDOW)
    return windows.join(done, WINDOW, "left_anti")


def latest_windows(bars: DataFrame, run_date: str, near_days: int = 10, far_days: int = 30) -> DataFrame:
    """Last two bars up to the run date: within the near range, else within the far range."""
    end = F.lit(run_date).cast("date")
    recent = bars.where((F.col("event_date") <= end) & (F.col("event_date") >= F.date_sub(end, far_days)))
    last_two = top_rows(recent, ["security_id"], [F.col("event_date").desc()], 2)
    pairs = last_two.groupBy("security_id").agg(
        F.min("event_date").alias("window_start"),
        F.max("event_date").alias("window_end"),
        F.min_by("adjusted_close", "event_date").alias("start_close"),
        F.max_by("adjusted_close", "event_date").alias("end_close"),
    )
    return pairs.where(F.col("window_start") < F.col("window_end")).select(
        "security_id",
        F.lit("daily").alias("cadence"),
        "window_start",
        "window_end",
        "start_close",
        "end_close",
        (F.col("window_start") < F.date_sub(end, near_days)).alias("used_far_range"),
    )


def skipped_windows(windows: DataFrame, results: DataFrame, reason: str) -> DataFrame:
    return windows.join(results.select(*WINDOW), WINDOW, "left_anti").select(
        *WINDOW, F.lit(reason).alias("skip_reason")
    )

"""Backfill jobs: each chooses its windows and attributes them as one plan."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.operators import pit, windows
from returnlens.plans.attribution import MarketData, Settings, attribute
from returnlens.vocab import METHODOLOGIES


def daily_batch(data: MarketData, settings: Settings, previous_date: str, for_date: str) -> tuple[DataFrame, DataFrame]:
    """One daily window for every security that has a bar on both days."""
    bars = pit.visible_bars(data.bars.where(F.col("event_date").isin(_day(previous_date), _day(for_date))), settings.cutoff)
    pairs = bars.groupBy("security_id").agg(
        F.min("event_date").alias("window_start"),
        F.max("event_date").alias("window_end"),
        F.min_by("adjusted_close", "event_date").alias("start_close"),
        F.max_by("adjusted_close", "event_date").alias("end_close"),
    )
    chosen = pairs.where(F.col("window_start") < F.col("window_end")).withColumn("cadence", F.lit("daily"))
    return attribute(data, settings, _shaped(chosen))


def latest_daily(data: MarketData, settings: Settings, run_date: str) -> tuple[DataFrame, DataFrame]:
    """The last daily window of every security up to a day, for proving runs."""
    chosen = windows.latest_windows(pit.visible_bars(data.bars, settings.cutoff), run_date)
    return attribute(data, settings, _shaped(chosen))


def pilot(
    data: MarketData,
    settings: Settings,
    start: str,
    end: str,
    window_limit: int | None = None,
    stored_runs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Windows that start in a span, at most ``window_limit`` a security and cadence, without those stored already."""
    span = data.bars.where(F.col("event_date").between(F.date_sub(_day(start), 2 * settings.lookback_days), _day(end)))
    built = windows.build_windows(pit.visible_bars(span, settings.cutoff), settings.cadences)
    chosen = windows.from_analysis_start(built, start)
    if window_limit is not None:
        chosen = windows.first_windows(chosen, window_limit)
    if stored_runs is not None:
        chosen = windows.not_yet_run(chosen, stored_runs, *METHODOLOGIES[settings.methodology])
    return attribute(data, replace(settings, require_history=False), _shaped(chosen))


def _day(text: str):
    return F.lit(text).cast("date")


def _shaped(chosen: DataFrame) -> DataFrame:
    return windows.with_observed_return(chosen.select(*windows.WINDOW, "start_close", "end_close"))

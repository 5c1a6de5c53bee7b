"""Point-in-time visibility, latest-row selection and as-of lookups.

Latest-row selection is a ranked window filtered to the first places, which Spark cuts down inside every map task
before the shuffle, so one key holding a large part of the rows stays cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def instant(cutoff: str | Column) -> Column:
    return F.lit(cutoff).cast("timestamp_ntz") if isinstance(cutoff, str) else cutoff


def visible(df: DataFrame, cutoff: str | Column, available: str = "timestamp_available") -> DataFrame:
    return df.where(F.col(available) <= instant(cutoff))


def active(df: DataFrame, moment: str | Column, start: str = "active_from", end: str = "active_to") -> DataFrame:
    at = instant(moment)
    return df.where((F.col(start) <= at) & (F.col(end).isNull() | (F.col(end) > at)))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def visible_bars(bars: DataFrame, cutoff: str | Column) -> DataFrame:
    """One bar per security and day: the latest visible one, ties by source name."""
    return top_rows(
        visible(bars, cutoff),
        ["security_id", "event_date"],
        [F.col("timestamp_available").desc(), F.col("source").asc()],
    )


def visible_factor_returns(factors: DataFrame, cutoff: str | Column) -> DataFrame:
    return top_rows(
        visible(factors, cutoff),
        ["factor_name", "event_date"],
        [F.col("timestamp_available").desc(), F.col("source").asc()],
    )


def visible_macro(series: DataFrame, cutoff: str | Column) -> DataFrame:
    return top_rows(
        visible(series, cutoff),
        ["series_name", "event_date"],
        [F.col("timestamp_available").desc(), F.col("source").asc(), F.col("vintage").asc_nulls_last()],
    )


def active_ticker_map(history: DataFrame) -> DataFrame:
    """Ticker to its one open-ended security: latest start wins, then the smaller id."""
    open_rows = history.where(F.col("active_to").isNull())
    return top_rows(open_rows, ["ticker"], [F.col("active_from").desc(), F.col("security_id").asc()])


def ticker_map_on(history: DataFrame, day: str | Column) -> DataFrame:
    """Ticker to security as it stood on a day, for renamed and delisted tickers."""
    return top_rows(active(history, day), ["ticker"], [F.col("active_from").desc(), F.col("security_id").asc()])


def latest_classification(classes: DataFrame, cutoff: str | Column | None = None) -> DataFrame:
    """Newest classification per security: by event day for a run, by availability for a summary."""
    if cutoff is None:
        order = [F.col("timestamp_available").desc(), F.col("event_date").desc()]
        return top_rows(classes, ["security_id"], order)
    return top_rows(visible(classes, cutoff), ["security_id"], [F.col("event_date").desc()])


def close_at(points: DataFrame, bars: DataFrame, day: str, cutoff: str | Column, name: str) -> DataFrame:
    """Adjusted close visible at the cutoff on exactly the day each point names; null when there is none."""
    wanted = points.select("security_id", F.col(day).alias("event_date")).distinct()
    asked = bars.join(wanted, ["security_id", "event_date"], "left_semi")
    prices = visible_bars(asked, cutoff).select(
        "security_id", F.col("event_date").alias(day), F.col("adjusted_close").alias(name)
    )
    return points.join(prices, ["security_id", day], "left")

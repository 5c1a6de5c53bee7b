"""Daily and window returns.

Bars reach this module with one row per security and calendar day, so a window over one security never holds more
rows than there are days in its history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BPS = 10_000


def by_security() -> Window:
    return Window.partitionBy("security_id").orderBy("event_date")


def move_bps(later: Column, earlier: Column) -> Column:
    return (F.try_divide(later, earlier) - 1.0) * BPS


def daily_returns(bars: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Return of every bar against the security's previous bar; null on the first bar."""
    w = by_security()
    return bars.select(
        "security_id",
        "event_date",
        "adjusted_close",
        F.lag("event_date").over(w).alias("prev_date"),
        move_bps(F.col("adjusted_close"), F.lag("adjusted_close").over(w)).alias("return_bps"),
        *(keep or []),
    )


def window_returns(windows: DataFrame, bars: DataFrame) -> DataFrame:
    """First to last visible bar inside any closed window; windows holding fewer than two bars give no row.

    Each window is laid out over the days it spans and met by day, so bars and windows join on equality.
    """
    days = F.explode(F.sequence("window_start", "window_end"))
    spread = windows.withColumn("event_date", days)
    inside = spread.join(bars.select("security_id", "event_date", "adjusted_close"), ["security_id", "event_date"])
    ends = inside.groupBy(*windows.columns).agg(
        F.min_by("adjusted_close", "event_date").alias("start_close"),
        F.max_by("adjusted_close", "event_date").alias("end_close"),
        F.count("*").alias("bars"),
    )
    return ends.where("bars >= 2").withColumn(
        "observed_return_bps", move_bps(F.col("end_close"), F.col("start_close"))
    )

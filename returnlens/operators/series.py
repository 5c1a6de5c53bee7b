"""Factor and macro series: changes, spreads, proxy returns and moves over windows.

Everything ends in one shape, ``(series_key, event_date, value, prev_date)``, one row per series and day.
``prev_date`` is set where a value is a change against an earlier observation that must itself lie inside the
estimation range; it is null where the value stands alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnlens.operators.returns import daily_returns, move_bps

# Macro factors built from one series: (factor, series, kind of change).
MACRO_FACTORS = [
    ("macro:2y_yield_change", "DGS2", "level"),
    ("macro:10y_yield_change", "DGS10", "level"),
    ("macro:hy_spread_change", "BAMLH0A0HYM2", "level"),
    ("macro:ig_spread_change", "BAMLC0A0CM", "level"),
    ("macro:vix_return", "VIXCLS", "percent"),
    ("macro:inflation_expectation_change", "T5YIE", "level"),
]
# The curve factor and its long and short legs.
CURVE_FACTOR = ("macro:2s10s_curve_change", "DGS10", "DGS2")
# Fixed value: order in which macro factors enter the layered model.
MACRO_ORDER = [
    "macro:2y_yield_change",
    "macro:10y_yield_change",
    "macro:2s10s_curve_change",
    "macro:hy_spread_change",
    "macro:ig_spread_change",
    "macro:vix_return",
    "macro:inflation_expectation_change",
]
LEVEL_MULTIPLIER = 100.0


def factor_series(factors: DataFrame) -> DataFrame:
    return factors.select(
        F.col("factor_name").alias("series_key"),
        "event_date",
        F.col("return_bps").alias("value"),
        F.lit(None).cast("date").alias("prev_date"),
    )


def level_changes(values: DataFrame, multiplier: Column | float) -> DataFrame:
    w = Window.partitionBy("series_key").orderBy("event_date")
    scale = F.lit(multiplier) if isinstance(multiplier, float) else multiplier
    return values.select(
        "series_key",
        "event_date",
        ((F.col("value") - F.lag("value").over(w)) * scale).alias("value"),
        F.lag("event_date").over(w).alias("prev_date"),
    ).where(F.col("prev_date").isNotNull())


def percent_changes(values: DataFrame) -> DataFrame:
    """Percent move in bps; a step from zero has no value."""
    w = Window.partitionBy("series_key").orderBy("event_date")
    return values.select(
        "series_key",
        "event_date",
        move_bps(F.col("value"), F.lag("value").over(w)).alias("value"),
        F.lag("event_date").over(w).alias("prev_date"),
    ).where(F.col("value").isNotNull())


def spread(macro: DataFrame, long_leg: str, short_leg: str, name: str) -> DataFrame:
    """Difference of two series on the days both have."""
    a = macro.where(F.col("series_name") == long_leg).select("event_date", F.col("value").alias("long_value"))
    b = macro.where(F.col("series_name") == short_leg).select("event_date", F.col("value").alias("short_value"))
    return a.join(b, "event_date").select(
        F.lit(name).alias("series_key"), "event_date", (F.col("long_value") - F.col("short_value")).alias("value")
    )


def macro_factor_series(macro: DataFrame) -> DataFrame:
    """All macro factors of the fixed set, from deduplicated macro observations."""

    def named(kind: str) -> DataFrame:
        pairs = [(series, factor) for factor, series, k in MACRO_FACTORS if k == kind]
        names = F.create_map(*[F.lit(part) for pair in pairs for part in pair])
        wanted = macro.where(F.col("series_name").isin([series for series, _ in pairs]))
        return wanted.select(names[F.col("series_name")].alias("series_key"), "event_date", "value")

    name, long_leg, short_leg = CURVE_FACTOR
    levels = named("level").unionByName(spread(macro, long_leg, short_leg, name))
    return level_changes(levels, LEVEL_MULTIPLIER).unionByName(percent_changes(named("percent")))


def proxy_factor_returns(bars: DataFrame, ticker_map: DataFrame, proxies: DataFrame) -> DataFrame:
    """Factor rows from proxy tickers' deduplicated bars; one ticker may stand for several factors."""
    owners = proxies.join(ticker_map.select("ticker", "security_id"), "ticker")
    owned = bars.join(owners.select("security_id").distinct(), "security_id", "left_semi")
    moves = daily_returns(owned, ["ingestion_time", "timestamp_available"]).where(F.col("return_bps").isNotNull())
    return moves.join(owners, "security_id").select(
        "factor_name",
        F.lit("sector").alias("factor_family"),
        "event_date",
        "return_bps",
        F.concat(F.lit("proxy_price:"), "ticker").alias("source"),
        "ingestion_time",
        "timestamp_available",
    )


def running_level(series: DataFrame) -> DataFrame:
    """Running sum of a series on every calendar day from its first to its last observation."""
    w = Window.partitionBy("series_key").orderBy("event_date")
    steps = series.select(
        "series_key",
        "event_date",
        F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("level"),
        F.lead("event_date").over(w).alias("next_date"),
    )
    until = F.coalesce(F.date_sub("next_date", 1), F.col("event_date"))
    return steps.select(
        "series_key", F.explode(F.sequence("event_date", until)).alias("event_date"), "level"
    )


def series_span(series: DataFrame) -> DataFrame:
    return series.groupBy("series_key").agg(
        F.min("event_date").alias("first_date"), F.max("event_date").alias("last_date")
    )


def attach_moves(rows: DataFrame, series: DataFrame) -> DataFrame:
    """Sum of each row's series over ``(window_start, window_end]`` as a difference of two running levels."""
    level = running_level(series)
    span = series_span(series)
    bounded = rows.join(span, "series_key")
    for edge in ("window_start", "window_end"):
        at = level.select("series_key", F.col("event_date").alias(f"_{edge}"), F.col("level").alias(f"_{edge}_level"))
        bounded = bounded.withColumn(f"_{edge}", F.least(F.col(edge), F.col("last_date"))).join(
            at, ["series_key", f"_{edge}"], "left"
        )
    move = F.coalesce(F.col("_window_end_level"), F.lit(0.0)) - F.coalesce(F.col("_window_start_level"), F.lit(0.0))
    extra = ["first_date", "last_date", "_window_start", "_window_end", "_window_start_level", "_window_end_level"]
    return bounded.withColumn("factor_move", move).drop(*extra)

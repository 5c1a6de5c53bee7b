"""Return-style descriptors: momentum, short-term reversal, realised volatility and liquidity.

Compounded returns telescope into price ratios, and averages over the last n bars are differences of running sums
kept per bar position, so every descriptor is a handful of equality lookups on ``(security, position)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnlens.operators.regression import trailing_sums
from returnlens.operators.returns import by_security, move_bps

STYLE_VERSION = "return-style-descriptor-v0"
MIN_RETURNS = 20
YEAR, MONTH, SKIP, QUARTER = 252, 21, 5, 60

# Descriptor, unit, observations for full confidence.
DESCRIPTORS = [
    ("momentum", "bps", 252),
    ("short_term_reversal", "bps", 21),
    ("realized_volatility", "annualized_bps", 60),
    ("liquidity", "log_average_daily_dollar_volume", 60),
]


def descriptor_confidence(observations: Column, target: int) -> Column:
    return (
        F.when(observations >= target, "Medium-High")
        .when(observations >= max(20, target // 2), "Medium")
        .otherwise("Low-Medium")
    )


def bar_positions(bars: DataFrame) -> DataFrame:
    """Bars with their position, neighbours at fixed distances and running sums."""
    w = by_security()
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lagged = bars.select(
        "security_id",
        "event_date",
        "adjusted_close",
        F.row_number().over(w).alias("position"),
        F.lag("adjusted_close", SKIP).over(w).alias("close_skip"),
        F.lag("adjusted_close", MONTH).over(w).alias("close_month"),
        F.lag("adjusted_close", YEAR).over(w).alias("close_year"),
        F.coalesce(move_bps(F.col("adjusted_close"), F.lag("adjusted_close").over(w)), F.lit(0.0)).alias("r"),
        F.when(F.col("volume").isNotNull(), F.col("adjusted_close") * F.col("volume")).alias("dollars"),
    )
    return lagged.select(
        "*",
        F.sum("r").over(run).alias("sum_r"),
        F.sum(F.col("r") * F.col("r")).over(run).alias("sum_rr"),
        F.coalesce(F.sum("dollars").over(run), F.lit(0.0)).alias("sum_dollars"),
        F.count("dollars").over(run).alias("n_dollars"),
    )


def _descriptors(ends: DataFrame, bars: DataFrame, keys: list[str]) -> DataFrame:
    """``ends``: keys, security and the positions of the first and last bar in range."""
    returns_from = F.greatest(F.col("first_position"), F.col("position") - QUARTER)
    bars_from = F.greatest(F.col("first_position") - 1, F.col("position") - QUARTER)
    spots = ends.withColumn("returns_from", returns_from).withColumn("bars_from", bars_from)

    def pick(name: str, prefix: str, columns: list[str]) -> DataFrame:
        return bars.select(
            "security_id", F.col("position").alias(name), *[F.col(c).alias(f"{prefix}_{c}") for c in columns]
        )

    looked = (
        spots.join(pick("first_position", "first", ["adjusted_close"]), ["security_id", "first_position"])
        .join(pick("returns_from", "ret", ["sum_r", "sum_rr"]), ["security_id", "returns_from"])
        .join(pick("bars_from", "bar", ["sum_dollars", "n_dollars"]), ["security_id", "bars_from"], "left")
    )
    n = F.col("position") - F.col("first_position")
    first, end = F.col("first_adjusted_close"), F.col("adjusted_close")
    used = F.least(n, F.lit(QUARTER))
    mean = (F.col("sum_r") - F.col("ret_sum_r")) / used
    variance = F.greatest((F.col("sum_rr") - F.col("ret_sum_rr")) / used - mean * mean, F.lit(0.0))
    priced = F.col("n_dollars") - F.coalesce("bar_n_dollars", F.lit(0))
    dollars = F.try_divide(F.col("sum_dollars") - F.coalesce("bar_sum_dollars", F.lit(0.0)), priced)
    bars_used = F.least(n + 1, F.lit(QUARTER))
    momentum = F.when(n >= YEAR, move_bps(F.col("close_month"), F.col("close_year"))).otherwise(
        move_bps(F.col("close_skip"), first)
    )
    reversal = -move_bps(end, F.when(n >= MONTH, F.col("close_month")).otherwise(first))
    counted = {"momentum": n, "short_term_reversal": n, "realized_volatility": n, "liquidity": bars_used}
    shown = {
        "momentum": n,
        "short_term_reversal": F.least(n, F.lit(MONTH)),
        "realized_volatility": used,
        "liquidity": bars_used,
    }
    values = {
        "momentum": momentum,
        "short_term_reversal": reversal,
        "realized_volatility": F.sqrt(variance) * F.sqrt(F.lit(252.0)),
        "liquidity": F.log1p(dollars),
    }
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("descriptor"),
                F.lit(unit).alias("unit"),
                values[name].alias("value"),
                shown[name].cast("long").alias("observations"),
                descriptor_confidence(counted[name], target).alias("confidence"),
            )
            for name, unit, target in DESCRIPTORS
        ]
    )
    enough = looked.where(n >= MIN_RETURNS)
    return enough.select(*keys, F.inline(entries)).where(F.col("value").isNotNull())


def history_descriptors(bars: DataFrame) -> DataFrame:
    """Descriptors of every security as of each of its bars, over its whole history so far."""
    placed = bar_positions(bars)
    return _descriptors(placed.withColumn("first_position", F.lit(1)), placed, ["security_id", "event_date"])


def window_descriptors(windows: DataFrame, bars: DataFrame, lookback_days: int) -> DataFrame:
    """Descriptors of each window over the bars from its lookback's start to its end."""
    placed = bar_positions(bars)
    counts = trailing_sums(
        placed, ["security_id"], {"n": F.lit(1.0)}, F.lit(True), F.col("event_date"), lookback_days
    )
    first = placed.join(counts, ["security_id", "event_date"]).select(
        "security_id",
        F.col("event_date").alias("window_start"),
        (F.col("position") - F.col("n").cast("int")).alias("first_position"),
    )
    ends = windows.join(first, ["security_id", "window_start"]).join(
        placed.withColumnRenamed("event_date", "window_end"), ["security_id", "window_end"]
    )
    return _descriptors(ends, placed, windows.columns)


def exposures_from_descriptors(descriptors: DataFrame, as_of: str | Column, keep: list[str] | None = None) -> DataFrame:
    """Exposure rows as they stand at ``as_of``, one moment for all or one a row; columns to ``keep`` come along."""
    at = F.lit(as_of).cast("timestamp_ntz") if isinstance(as_of, str) else as_of
    return descriptors.select(
        "security_id",
        F.col("descriptor").alias("factor_name"),
        F.col("value").alias("exposure_value"),
        F.col("unit").alias("exposure_unit"),
        F.lit(STYLE_VERSION).alias("exposure_method"),
        "confidence",
        F.lit(STYLE_VERSION).alias("model_version"),
        F.to_json(F.struct("observations", F.lit(STYLE_VERSION).alias("model_version"))).alias("diagnostics"),
        at.alias("event_time"),
        at.alias("ingestion_time"),
        at.alias("timestamp_available"),
        *(keep or []),
    )



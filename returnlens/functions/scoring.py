"""Column functions for shares, confidence, surprises and exposure gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from returnlens.vocab import COLLINEAR_CONDITION, CONFIDENCE_LADDER, MAX_ABS_BPS, SHARE_THRESHOLD_BPS


def share_is_stable(observed_bps: Column, threshold: float = SHARE_THRESHOLD_BPS) -> Column:
    return F.abs(observed_bps) >= F.lit(threshold)


def plain_share(bps: Column, observed_bps: Column) -> Column:
    return F.try_divide(bps, observed_bps)


def safe_share(bps: Column, observed_bps: Column, threshold: float = SHARE_THRESHOLD_BPS) -> Column:
    return F.when(share_is_stable(observed_bps, threshold), F.try_divide(bps, observed_bps))


def display_share(share: Column, observed_bps: Column, threshold: float = SHARE_THRESHOLD_BPS) -> Column:
    return F.when(share_is_stable(observed_bps, threshold), share)


def residual_usd(residual_bps: Column, observed_bps: Column, price_change: Column) -> Column:
    return safe_share(residual_bps, observed_bps) * price_change


def is_usable_bps(bps: Column) -> Column:
    return bps.isNotNull() & ~F.isnan(bps) & (F.abs(bps) <= F.lit(MAX_ABS_BPS))


def share_denominator(observed_bps: Column, threshold: float = SHARE_THRESHOLD_BPS) -> Column:
    return F.greatest(F.abs(observed_bps), F.lit(threshold))


def residual_confidence(residual_bps: Column, denominator: Column) -> Column:
    return F.when(F.abs(residual_bps) > denominator * 0.5, "Low").otherwise("Medium")


def confidence_after(penalty: Column) -> Column:
    """Step down from the top of the ladder by ``penalty`` places, stopping at the floor."""
    ladder = F.array(*[F.lit(level) for level in CONFIDENCE_LADDER])
    return F.element_at(ladder, F.least(F.lit(len(CONFIDENCE_LADDER)), penalty.cast("int") + 1))


def factor_penalty(
    observations: Column,
    min_observations: Column | int,
    condition_number: Column | None = None,
    stale: Column | None = None,
    proxy_mismatch: Column | None = None,
    unstable_sign: Column | None = None,
) -> Column:
    floor = F.lit(min_observations) if isinstance(min_observations, int) else min_observations
    total = F.when(observations < floor, 2).otherwise(0)
    if condition_number is not None:
        total = total + F.when(condition_number > COLLINEAR_CONDITION, 1).otherwise(0)
    for flag in (stale, proxy_mismatch, unstable_sign):
        if flag is not None:
            total = total + F.when(flag, 1).otherwise(0)
    return total


def days_to_cover(short_interest: Column, average_daily_volume: Column) -> Column:
    return F.when(average_daily_volume > 0, short_interest / average_daily_volume)


def short_interest_share(short_interest: Column, float_shares: Column) -> Column:
    return F.when(float_shares > 0, short_interest / float_shares)


def short_interest_confidence(float_shares: Column) -> Column:
    return F.when(float_shares.isNull(), "Medium").otherwise("Medium-High")


def numeric_surprise(actual: Column, expected: Column, scale: Column | None = None) -> Column:
    floor = F.greatest(F.abs(expected), F.lit(1e-9))
    unit = floor if scale is None else F.coalesce(scale, floor)
    return F.try_divide(actual - expected, unit)


def surprise_direction(value: Column, band: float = 0.01) -> Column:
    return F.when(value > band, "positive").when(value < -band, "negative").otherwise("neutral")


def exposure_bucket(value: Column) -> Column:
    return (
        F.when(value <= 0, "none")
        .when(value < 0.35, "low")
        .when(value < 0.65, "medium")
        .when(value < 0.90, "high")
        .otherwise("critical")
    )


# Gate weight of each exposure bucket.
BUCKET_GATE = {
    "none": 0.0,
    "low": 0.25,
    "medium": 0.50,
    "high": 0.75,
    "critical": 1.0,
}


def bucket_gate(bucket: Column) -> Column:
    weights = F.create_map(*[F.lit(part) for pair in BUCKET_GATE.items() for part in pair])
    return F.when(bucket.isNull(), F.lit(0.0)).otherwise(F.try_element_at(weights, bucket))


def fixed_text(value: Column, places: int) -> Column:
    """A finite number with so many decimals: the exact stored value is rounded, and true halves go to even."""
    return F.call_function("format_number", value, F.lit("0." + "0" * places))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def sign_name(value: Column) -> Column:
    return F.when(value > 0, "positive").when(value < 0, "negative").otherwise("unknown")


def hedged_net(gain: Column, cost: Column, hedge: Column) -> Column:
    return (gain - cost) * (1 - hedge)


def commodity_gate(producer: Column, consumer: Column, hedge: Column, threshold: float = 0.20) -> Column:
    net = hedged_net(producer, consumer, hedge)
    return F.struct(
        clamp01(F.abs(net) / threshold).alias("gate_weight"),
        sign_name(net).alias("expected_sign"),
        net.alias("score"),
    )


def fx_gate(revenue: Column, cost: Column, hedge: Column, threshold: float = 0.20) -> Column:
    """A net foreign-revenue earner is hurt by a stronger dollar, hence the opposite sign."""
    net = hedged_net(revenue, cost, hedge)
    return F.struct(
        clamp01(F.abs(net) / threshold).alias("gate_weight"),
        sign_name(-net).alias("expected_sign"),
        net.alias("score"),
    )


def rate_gate(floating: Column, net_debt: Column, interest: Column, sensitivity: Column, threshold: float = 1.0) -> Column:
    score = (floating + net_debt + interest + sensitivity) / 4
    return F.struct(
        clamp01(F.abs(score) / threshold).alias("gate_weight"),
        sign_name(score).alias("expected_sign"),
        score.alias("score"),
    )


def credit_gate(leverage_z: Column, coverage_z: Column, maturity_z: Column, rating_z: Column) -> Column:
    score = (leverage_z - coverage_z + maturity_z - rating_z) / 4
    return F.struct(
        (1 / (1 + F.exp(-score))).alias("gate_weight"),
        F.lit("negative").alias("expected_sign"),
        score.alias("score"),
    )

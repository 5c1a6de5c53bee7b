"""Which inputs the windows of an attribution read, how new they are, and which windows late data touches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from returnlens.operators import models, peers, pit, windows
from returnlens.operators.availability import newest_inputs, stale_windows, together
from returnlens.operators.series import CURVE_FACTOR, MACRO_FACTORS
from returnlens.plans.attribution import MarketData, Settings, attribute, select_windows
from returnlens.vocab import FIVE_FACTORS, METHODOLOGIES


@dataclass(frozen=True)
class Inputs:
    """``uses``: security_id, kind, key, back. ``facts``: kind, key, event_date, value. ``standing``: security_id, kind, value."""

    uses: DataFrame
    facts: DataFrame
    standing: DataFrame


def _use(df: DataFrame, kind: str, key, back: int) -> DataFrame:
    return df.select("security_id", F.lit(kind).alias("kind"), key.cast("string").alias("key"), F.lit(back).alias("back")).distinct()


def _fact(df: DataFrame, kind: str, key: str, day, value="timestamp_available") -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), day.cast("date").alias("event_date"), F.col(value).alias("value"))


def used_inputs(data: MarketData, settings: Settings) -> Inputs:
    """The rows an expanded attribution at the settings' cutoff reads, with their availability.

    Kinds: bar, factor, macro, peer (a return stands on two bars, so it is as new as the newer of them), event, and
    classification, basket, exposure, which hold for every window.
    """
    cutoff, back = settings.cutoff, settings.lookback_days
    bars = pit.visible_bars(data.bars, cutoff)
    everyone = data.securities.select("security_id")
    uses = [_use(everyone, "bar", F.col("security_id"), back)]
    facts = [_fact(bars, "bar", "security_id", F.col("event_date"))]

    five = everyone.select("security_id", F.explode(F.array(*[F.lit(k) for k in FIVE_FACTORS])).alias("series_key"))
    factor_keys = five if data.classes is None else five.unionByName(models.sector_assignments(data.classes, cutoff).select("security_id", "series_key"))
    uses.append(_use(factor_keys, "factor", F.col("series_key"), back))
    facts.append(_fact(pit.visible_factor_returns(data.factors, cutoff), "factor", "factor_name", F.col("event_date")))

    standing = []
    if data.classes is not None:
        current = pit.latest_classification(data.classes, cutoff)
        standing.append(current.select("security_id", F.lit("classification").alias("kind"), F.col("timestamp_available").alias("value")))
    if data.macro is not None and data.exposures is not None:
        name, long_leg, short_leg = CURVE_FACTOR
        legs = [(factor, series) for factor, series, _ in MACRO_FACTORS] + [(name, long_leg), (name, short_leg)]
        sources = F.array(*[F.struct(F.lit(f).alias("series_key"), F.lit(s).alias("series_name")) for f, s in legs])
        gated = models.macro_assignments(data.securities, data.exposures, cutoff).select("security_id", "series_key")
        named = everyone.select("security_id", F.inline(sources)).join(gated, ["security_id", "series_key"])
        uses.append(_use(named, "macro", F.col("series_name"), back))
        facts.append(_fact(pit.visible_macro(data.macro, cutoff), "macro", "series_name", F.col("event_date")))
        seen = pit.visible(data.exposures, cutoff).join(data.securities.select("security_id", "company_id"), "company_id")
        standing.append(seen.groupBy("security_id").agg(F.max("timestamp_available").alias("value")).select("security_id", F.lit("exposure").alias("kind"), "value"))
    if data.baskets is not None:
        members = peers.active_members(data.baskets, data.members, cutoff)
        weights = peers.normalised_weights(members, cutoff)
        uses.append(_use(weights.select(F.col("target_security_id").alias("security_id"), "peer_security_id"), "peer", F.col("peer_security_id"), back))
        along = Window.partitionBy("security_id").orderBy("event_date")
        pairs = bars.withColumn("value", F.greatest("timestamp_available", F.lag("timestamp_available").over(along)))
        pairs = pairs.withColumn("prev_date", F.lag("event_date").over(along)).where(F.col("prev_date").isNotNull())
        facts.append(_fact(pairs, "peer", "security_id", F.col("event_date"), "value"))
        baskets = pit.visible(data.baskets, cutoff).select(F.col("target_security_id").alias("security_id"), "timestamp_available")
        rows = members.select(F.col("target_security_id").alias("security_id"), "timestamp_available").unionByName(baskets)
        standing.append(rows.groupBy("security_id").agg(F.max("timestamp_available").alias("value")).select("security_id", F.lit("basket").alias("kind"), "value"))
    if data.events is not None and settings.include_events:
        uses.append(_use(data.securities, "event", F.col("company_id"), 0))
        facts.append(_fact(pit.visible(data.events, cutoff), "event", "company_id", F.col("event_time")))
    none = data.securities.select("security_id", F.lit("").alias("kind"), F.lit(None).cast("timestamp_ntz").alias("value")).limit(0)
    return Inputs(together(uses), together(facts), together([none, *standing]))


def newest(chosen: DataFrame, inputs: Inputs) -> DataFrame:
    return newest_inputs(chosen, inputs.uses, inputs.facts, inputs.standing)


def touched_windows(data: MarketData, settings: Settings, stored_runs: DataFrame, since: str) -> DataFrame:
    """Windows to attribute again at the settings' cutoff: those never stored, and those that read anything which became
    available after ``since``, the cutoff of the stored runs: restated bars, factors and macro values, late events, new
    classifications, exposures, baskets and members."""
    model, basket = METHODOLOGIES[settings.methodology]
    every = select_windows(pit.visible_bars(data.bars, settings.cutoff), settings)
    fresh = windows.not_yet_run(every, stored_runs, model, basket)
    stale = stale_windows(every, newest(every, used_inputs(data, settings)), since)
    return fresh.unionByName(stale.join(fresh.select(*windows.WINDOW), windows.WINDOW, "left_anti"))


def refresh(data: MarketData, settings: Settings, stored_runs: DataFrame, since: str) -> tuple[DataFrame, DataFrame]:
    """Runs and contributions of exactly the windows that late or restated data touches."""
    return attribute(data, settings, touched_windows(data, settings, stored_runs, since))

"""Attribution models: each turns windows into contribution rows of one shared shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.scoring import clamp01, confidence_after, factor_penalty, fixed_text
from returnlens.operators.events import classify, events_in_windows
from returnlens.operators.exposures import macro_gates
from returnlens.operators.pit import latest_classification
from returnlens.operators.regression import multi_betas, trailing_betas, trailing_moments
from returnlens.operators.series import attach_moves
from returnlens.operators.style import STYLE_VERSION, window_descriptors
from returnlens.vocab import COLLINEAR_CONDITION, EVIDENCE_ONLY, FIVE_FACTOR_DRIVER, FIVE_FACTORS, PRODUCTION

SECTOR_VERSION = "sector-factor-v0"
PEER_VERSION = "peer-basket-v0"
MACRO_VERSION = "macro-factor-v0"
EVENT_POLICY = "evidence_only_until_event_study_calibration"

MIN_PAIRS = {"market": 5, "sector": 10, "peer": 10, "macro": 20}


def _number(label: str, value: Column) -> Column:
    plain = F.concat(F.lit(f"{label}="), fixed_text(value, 4))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.format_string(f"{label}=%.4f", value)).otherwise(plain)


def _count(value: Column) -> Column:
    return F.format_string("observations=%d", value)


def contribution_rows(df: DataFrame, cutoff: str, **fields: Column) -> DataFrame:
    """Project onto the shared contribution shape; anything not given takes its neutral value."""
    neutral = {
        "contribution_bps": F.lit(0.0),
        "contribution_stage": F.lit(PRODUCTION),
        "beta": F.lit(None).cast("double"),
        "factor_move": F.lit(None).cast("double"),
        "observations": F.lit(None).cast("long"),
        "condition_number": F.lit(None).cast("double"),
        "evidence": F.array().cast("array<string>"),
        "evidence_payload": F.lit("{}"),
        "event_time": F.col("window_end").cast("timestamp_ntz"),
        "timestamp_available": F.lit(cutoff).cast("timestamp_ntz"),
    }
    chosen = {**neutral, **fields}
    order = ["driver", "name", "contribution_bps", "confidence", *[n for n in neutral if n != "contribution_bps"]]
    return df.select(
        "security_id",
        "cadence",
        "window_start",
        "window_end",
        "observed_return_bps",
        *[chosen[n].alias(n) for n in order],
    )


def market_assignments(securities: DataFrame) -> DataFrame:
    return securities.select(
        "security_id",
        F.lit("Mkt-RF").alias("series_key"),
        F.lit("market").alias("driver"),
        F.lit("Market factor (Mkt-RF)").alias("name"),
        F.lit(1.0).alias("gate"),
        F.lit(None).cast("string").alias("basket_name"),
        F.lit(None).cast("string").alias("basket_version"),
    )


def sector_assignments(classes: DataFrame, cutoff: str) -> DataFrame:
    """Sector and, where known, industry factor of each security's newest visible classification."""
    current = latest_classification(classes, cutoff)
    keys = F.array_compact(
        F.array(F.concat(F.lit("sector:"), "sector"), F.concat(F.lit("industry:"), F.nullif("industry", F.lit(""))))
    )
    return current.select("security_id", F.explode(keys).alias("series_key")).select(
        "security_id",
        "series_key",
        F.lit("sector").alias("driver"),
        F.concat(F.lit("Sector/industry factor ("), "series_key", F.lit(")")).alias("name"),
        F.lit(1.0).alias("gate"),
        F.lit(None).cast("string").alias("basket_name"),
        F.lit(None).cast("string").alias("basket_version"),
    )


def peer_assignments(compositions: DataFrame) -> DataFrame:
    return compositions.select(
        F.col("target_security_id").alias("security_id"),
        "series_key",
        F.lit("peer").alias("driver"),
        F.concat(F.lit("Peer basket ("), "basket_name", F.lit(")")).alias("name"),
        F.lit(1.0).alias("gate"),
        "basket_name",
        "basket_version",
    )


def macro_assignments(securities: DataFrame, exposures: DataFrame, cutoff: str) -> DataFrame:
    """Macro factors with a positive gate for each security."""
    gates = macro_gates(securities, exposures, cutoff).withColumn("gate", clamp01(F.col("gate")))
    return gates.where(F.col("gate") > 0).select(
        "security_id",
        "series_key",
        F.lit("macro").alias("driver"),
        F.concat(F.lit("Macro factor ("), "series_key", F.lit(")")).alias("name"),
        "gate",
        F.lit(None).cast("string").alias("basket_name"),
        F.lit(None).cast("string").alias("basket_version"),
    )


def simple_factor_rows(
    windows: DataFrame,
    returns: DataFrame,
    assigned: DataFrame,
    series: DataFrame,
    lookback_days: int,
    cutoff: str,
) -> DataFrame:
    """Beta times move for every window and assigned series with enough paired observations.

    Serves the market, sector, peer and macro models alike; they differ only in what they assign.
    """
    betas = trailing_betas(returns, assigned.select("security_id", "series_key"), series, lookback_days)
    floor = F.coalesce(*[F.when(F.col("driver") == d, F.lit(n)) for d, n in MIN_PAIRS.items()])
    fitted = (
        betas.join(assigned, ["security_id", "series_key"])
        .where(F.col("observations") >= floor)
        .join(windows, ["security_id", "window_start"])
    )
    moved = attach_moves(fitted, series)
    driver, beta, move = F.col("driver"), F.col("beta"), F.col("factor_move")
    label = F.when(driver == "peer", "peer_basket_return_bps").when(driver == "macro", "factor_move").otherwise(
        "factor_return_bps"
    )
    version = (
        F.when(driver == "sector", SECTOR_VERSION).when(driver == "peer", PEER_VERSION).when(driver == "macro", MACRO_VERSION)
    )
    evidence = F.array_compact(
        F.array(
            _number("beta", beta),
            F.concat(label, F.format_string("=%.4f", move)),
            F.when(driver == "macro", _number("exposure_gate", F.col("gate"))),
            _count(F.col("observations")),
            F.when(driver == "peer", F.concat(F.lit("basket_version="), "basket_version")),
            F.when(driver != "market", F.concat(F.lit("model="), version)),
        )
    )
    details = F.struct(
        F.when(driver != "peer", F.col("series_key")).alias("factor_name"),
        "basket_name",
        "basket_version",
        beta.alias("beta"),
        F.when(driver != "macro", move).alias("factor_move_bps"),
        F.when(driver == "macro", move).alias("factor_move"),
        F.when(driver == "macro", F.col("gate")).alias("exposure_gate"),
        F.col("observations").alias("observations"),
        version.alias("model_version"),
    )
    confidence = F.when(driver == "market", "Medium").otherwise(
        confidence_after(factor_penalty(F.col("observations"), floor))
    )
    return contribution_rows(
        moved,
        cutoff,
        driver=driver,
        name=F.col("name"),
        contribution_bps=beta * move * F.col("gate"),
        confidence=confidence,
        beta=beta,
        factor_move=move,
        observations=F.col("observations"),
        evidence=evidence,
        evidence_payload=F.when(driver == "market", F.lit("{}")).otherwise(F.to_json(details)),
    )


def wide_factors(series: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """One row per day with the named series side by side."""
    columns = [f"f{i}" for i in range(len(keys))]
    wide = series.where(F.col("series_key").isin(keys)).groupBy("event_date").agg(
        *[F.max(F.when(F.col("series_key") == k, F.col("value"))).alias(c) for k, c in zip(keys, columns)]
    )
    return wide, columns


def five_factor_rows(
    windows: DataFrame,
    returns: DataFrame,
    series: DataFrame,
    lookback_days: int,
    cutoff: str,
    min_observations: int | None = None,
    factors: list[str] = FIVE_FACTORS,
) -> DataFrame:
    """Joint regression on the daily factors; one row per factor."""
    k = len(factors)
    floor = min_observations or max(10, 2 * k)
    chosen = series.where(F.col("series_key").isin(factors))
    wide, columns = wide_factors(chosen, factors)
    fits = multi_betas(trailing_moments(returns, wide, columns, lookback_days), k, floor)
    entries = F.array(
        *[F.struct(F.lit(f).alias("series_key"), F.get("betas", F.lit(i)).alias("beta")) for i, f in enumerate(factors)]
    )
    per_factor = fits.select("security_id", "window_start", "observations", "condition_number", F.inline(entries))
    moved = attach_moves(per_factor.join(windows, ["security_id", "window_start"]), chosen)
    drivers = F.create_map(*[F.lit(p) for pair in FIVE_FACTOR_DRIVER.items() for p in pair])
    beta, move, condition = F.col("beta"), F.col("factor_move"), F.col("condition_number")
    return contribution_rows(
        moved,
        cutoff,
        driver=drivers[F.col("series_key")],
        name=F.concat(F.lit("French factor ("), "series_key", F.lit(")")),
        contribution_bps=beta * move,
        confidence=F.when(condition > COLLINEAR_CONDITION, "Low-Medium").otherwise("Medium"),
        beta=beta,
        factor_move=move,
        observations=F.col("observations"),
        condition_number=condition,
        evidence=F.array(
            _number("beta", beta),
            _number("factor_return_bps", move),
            _count(F.col("observations")),
            _number("condition_number", condition),
        ),
    )


def style_rows(windows: DataFrame, bars: DataFrame, lookback_days: int, cutoff: str) -> DataFrame:
    """Descriptors as evidence rows that carry no basis points."""
    keys = ["security_id", "cadence", "window_start", "window_end", "observed_return_bps"]
    found = window_descriptors(windows.select(*keys), bars, lookback_days)
    value = F.col("value")
    return contribution_rows(
        found,
        cutoff,
        driver=F.lit("style"),
        name=F.concat(F.lit("Style descriptor ("), "descriptor", F.lit(")")),
        confidence=F.col("confidence"),
        contribution_stage=F.lit(EVIDENCE_ONLY),
        beta=value,
        observations=F.col("observations"),
        evidence=F.array(
            _number("value", value), F.concat(F.lit("unit="), "unit"), F.lit(f"model={STYLE_VERSION}")
        ),
        evidence_payload=F.to_json(
            F.struct(
                F.col("descriptor").alias("descriptor_name"),
                "value",
                "unit",
                "observations",
                F.when(F.col("descriptor") == "liquidity", F.expm1(value)).alias("average_daily_dollar_volume"),
                F.lit(STYLE_VERSION).alias("model_version"),
            )
        ),
    )


def event_rows(windows: DataFrame, events: DataFrame, securities: DataFrame, cutoff: str) -> DataFrame:
    """Classified events inside each window as evidence rows, keeping the events' own times.

    What an event says is put into words once an event, not once for every window it lies in. Events are spread over all
    tasks before that: a few files may hold many, and every one of them makes several wide rows.
    """
    keys = ["security_id", "cadence", "window_start", "window_end", "observed_return_bps"]
    kinds = classify(events.repartition("event_id"))
    texts = {
        "_name": F.concat(F.lit("Event evidence ("), F.concat_ws("/", "event_category", "event_subtype"), F.lit(")")),
        "_evidence": F.array(
            F.concat(F.lit("source="), "source"),
            F.concat(F.lit("source_id="), "source_id"),
            F.concat(F.lit("category="), "event_category"),
            F.concat(F.lit("subtype="), "event_subtype"),
            F.lit("causal_contribution=not_assigned"),
        ),
        "_payload": F.to_json(
            F.struct(
                F.col("event_id").cast("string").alias("event_id"),
                "source",
                "source_id",
                "event_type",
                "event_category",
                "event_subtype",
                "event_direction",
                "materiality",
                F.lit(EVENT_POLICY).alias("contribution_policy"),
            )
        ),
    }
    told = kinds.select("company_id", "event_time", "timestamp_available", *[text.alias(n) for n, text in texts.items()])
    return contribution_rows(
        events_in_windows(windows.select(*keys), told, securities, cutoff),
        cutoff,
        driver=F.lit("event"),
        name=F.col("_name"),
        confidence=F.lit("Medium"),
        contribution_stage=F.lit(EVIDENCE_ONLY),
        evidence=F.col("_evidence"),
        evidence_payload=F.col("_payload"),
        event_time=F.col("event_time"),
        timestamp_available=F.col("timestamp_available"),
    )

"""Company exposures: macro gates, generated exposure rows and review decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.scoring import exposure_bucket
from returnlens.operators.pit import top_rows, visible

# Fixed value: version string stored with a decision.
POLICY_VERSION = "exposure-update-policy-v0"

# Macro factor to the exposure that gates it and the gate when the company has none.
MACRO_GATES = {
    "macro:2y_yield_change": ("rates", 1.0),
    "macro:10y_yield_change": ("rates", 1.0),
    "macro:2s10s_curve_change": ("rates", 1.0),
    "macro:hy_spread_change": ("credit", 1.0),
    "macro:ig_spread_change": ("credit", 1.0),
    "macro:vix_return": (None, 1.0),
    "macro:inflation_expectation_change": ("inflation", 0.5),
}


def macro_gates(securities: DataFrame, exposures: DataFrame, cutoff: str) -> DataFrame:
    """Gate of every macro factor for every security, from the newest visible exposures of its company."""
    current = top_rows(
        visible(exposures, cutoff),
        ["company_id", "exposure_name"],
        [F.col("timestamp_available").desc(), F.col("model_version").asc()],
    )
    names = sorted({name for name, _ in MACRO_GATES.values() if name})
    held = current.where(F.col("exposure_name").isin(names)).groupBy("company_id").agg(
        *[F.max(F.when(F.col("exposure_name") == n, F.col("exposure_value"))).alias(n) for n in names]
    )
    gates = F.array(
        *[
            F.struct(
                F.lit(factor).alias("series_key"),
                (F.coalesce(F.col(name), F.lit(default)) if name else F.lit(default)).alias("gate"),
            )
            for factor, (name, default) in MACRO_GATES.items()
        ]
    )
    return securities.select("security_id", "company_id").join(held, "company_id", "left").select(
        "security_id", F.inline(gates)
    )


def _mentions(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


def sector_macro_exposures(candidates: DataFrame) -> DataFrame:
    """Generated rates, credit and inflation exposures from the words in sector and industry.

    The word rules apply in order; later ones may raise or lower what earlier ones set.
    """
    text = F.lower(F.concat_ws(" ", F.coalesce("sector", F.lit("")), F.coalesce("industry", F.lit(""))))
    # Starting levels, keywords and levels of each rule.
    start = {"rates": 0.65, "credit": 0.65, "inflation": 0.50}
    rules = [
        (["financial", "bank", "mortgage", "insurance", "real estate", "utility"],
         {"rates": ("set", 0.90), "credit": ("set", 0.85)}),
        (["consumer discretionary", "retail", "auto", "airline", "hotel"],
         {"rates": ("floor", 0.80), "credit": ("floor", 0.75)}),
        (["energy", "oil", "gas", "materials", "metals", "chemical"],
         {"inflation": ("set", 0.85), "credit": ("floor", 0.75)}),
        (["technology", "software", "semiconductor", "communication"],
         {"credit": ("cap", 0.55)}),
        (["health care", "pharmaceutical", "biotechnology"],
         {"rates": ("cap", 0.55), "credit": ("cap", 0.55)}),
    ]
    levels = {name: F.lit(level) for name, level in start.items()}
    apply = {
        "set": lambda old, level: level,
        "floor": lambda old, level: F.greatest(old, level),
        "cap": lambda old, level: F.least(old, level),
    }
    for words, effects in rules:
        hit = _mentions(text, words)
        for name, (how, level) in effects.items():
            levels[name] = F.when(hit, apply[how](levels[name], F.lit(level))).otherwise(levels[name])
    rows = F.array(
        *[F.struct(F.lit(n).alias("exposure_name"), v.alias("exposure_value")) for n, v in levels.items()]
    )
    return candidates.select("company_id", "ticker", "sector", "industry", "first_price_date", F.inline(rows)).select(
        "company_id",
        "exposure_name",
        "exposure_value",
        exposure_bucket(F.col("exposure_value")).alias("exposure_bucket"),
        F.lit("positive").alias("exposure_sign"),
        F.concat_ws(
            ":", "ticker", F.coalesce("sector", F.lit("Unknown")), F.coalesce("industry", F.lit("Unknown"))
        ).alias("source_span"),
        F.lit("Low-Medium").alias("confidence"),
        F.col("first_price_date").alias("event_date"),
    )


def heuristic_exposures(securities: DataFrame, mapping_version: str, model_version: str) -> DataFrame:
    """Exposure rows from sector and industry names, later rules overriding earlier ones."""

    def table(entries: dict[str, float]) -> Column:
        return F.create_map(*[part for k, v in entries.items() for part in (F.lit(k), F.lit(v))])

    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    sector, industry = F.col("sector"), F.col("industry")
    # Exposures everyone has, and what each rule sets.
    steps = [
        (F.lit(True), {"rates": 0.5, "credit": 0.35, "inflation": 0.35}),
        (sector.isin("Financials", "Real Estate", "Utilities"), {"rates": 0.85, "credit": 0.75}),
        (sector == "Energy", {"wti": 0.9, "natural_gas": 0.6, "credit": 0.5}),
        (sector.isin("Consumer Staples", "Consumer Discretionary", "Materials"), {"inflation": 0.65}),
        (F.contains(industry, F.lit("Bank")) | F.contains(industry, F.lit("Financial")), {"rates": 0.9, "credit": 0.9}),
    ]

    def overlay(held: Column, update: Column) -> Column:
        return F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key(update, k)), update)

    merged = nothing
    for applies, entries in steps:
        merged = overlay(merged, F.when(applies, table(entries)).otherwise(nothing))
    return securities.select("company_id", "ticker", F.explode(merged).alias("exposure_name", "exposure_value")).select(
        "company_id",
        "ticker",
        "exposure_name",
        "exposure_value",
        exposure_bucket(F.col("exposure_value")).alias("exposure_bucket"),
        F.lit("positive").alias("exposure_sign"),
        F.concat_ws(":", F.lit("universe"), "ticker", "exposure_name").alias("source_span"),
        F.lit(mapping_version).alias("exposure_version"),
        F.lit("Medium").alias("confidence"),
        F.lit(model_version).alias("model_version"),
    )


def reviewed_exposure(event_type: Column) -> Column:
    """Exposure a filing of this form speaks about."""
    form = F.upper(F.coalesce(event_type, F.lit("")))
    # Forms and the exposures they speak about.
    return (
        F.when(form.isin("10-K", "10-Q"), "periodic_financial_reporting")
        .when(form == "8-K", "corporate_event_disclosure")
        .when(form.isin("13G", "SCHEDULE 13G", "13D", "SC 13D"), "ownership_structure")
        .when(form.isin("4", "144"), "insider_activity")
        .otherwise("general_disclosure")
    )


def recent_features(features: DataFrame, events: DataFrame, evaluated_at: str, lookback_days: int) -> DataFrame:
    """Features available within the lookback, with their event's form."""
    at = F.lit(evaluated_at).cast("timestamp_ntz")
    since = at - F.expr(f"INTERVAL {int(lookback_days)} DAY")
    inside = features.where((F.col("timestamp_available") >= since) & (F.col("timestamp_available") <= at))
    return inside.join(events.select("event_id", "event_type"), "event_id")


def _reviewable() -> Column:
    return (F.col("relevance") >= 0.80) & (F.col("magnitude") >= 0.50) & (F.col("novelty") >= 0.45)


def exposure_decisions(features: DataFrame, evaluated_at: str) -> DataFrame:
    """Review decision per company and exposure, from features that carry their event's form."""
    high = (F.col("relevance") >= 0.90) & (F.col("magnitude") >= 0.65)
    tallied = (
        features.withColumn("exposure_name", reviewed_exposure(F.col("event_type")))
        .groupBy("company_id", "exposure_name")
        .agg(
            F.count("*").alias("feature_count"),
            F.count_if(_reviewable()).alias("review_count"),
            F.count_if(high).alias("high_impact_count"),
        )
    )
    review = (F.col("review_count") >= 2) | (F.col("high_impact_count") > 0)
    # Fixed text: the rationale of either decision.
    reason = F.when(
        F.col("review_required"),
        F.format_string(
            "%d material structured event feature(s) for %s; "
            "MVP policy requires human review before structural exposure changes.",
            F.col("review_count"),
            F.col("exposure_name"),
        ),
    ).otherwise(
        F.format_string(
            "%d event feature(s) for %s, but evidence is not persistent or material enough for an exposure update.",
            F.col("feature_count"),
            F.col("exposure_name"),
        )
    )
    return tallied.withColumn("review_required", review).select(
        "company_id",
        "exposure_name",
        F.when(F.col("review_required"), "candidate_review").otherwise("no_update").alias("decision"),
        "review_required",
        F.when(F.col("review_required"), "Medium").otherwise("Medium-High").alias("confidence"),
        reason.alias("rationale"),
        "review_count",
        "feature_count",
        F.lit(POLICY_VERSION).alias("model_version"),
        F.lit(evaluated_at).cast("timestamp_ntz").alias("evaluated_at"),
    )


def decision_evidence(features: DataFrame, decisions: DataFrame) -> DataFrame:
    """Events behind each decision, one row each: all reviewable ones, else the first three seen.

    Kept long rather than as an array, because one company may hold any number of events.
    """
    keys = ["company_id", "exposure_name"]
    named = features.withColumn("exposure_name", reviewed_exposure(F.col("event_type")))
    verdict = decisions.select(*keys, "review_count")
    reviewed = named.where(_reviewable()).join(verdict.where("review_count > 0"), keys, "left_semi")
    others = named.join(verdict.where("review_count = 0"), keys, "left_semi")
    first = top_rows(others, keys, [F.col("timestamp_available").asc(), F.col("event_id").asc()], 3)
    return reviewed.select(*keys, "event_id").unionByName(first.select(*keys, "event_id"))


def recent_decisions(decisions: DataFrame, securities: DataFrame, ticker_map: DataFrame, ticker: str, n: int = 25) -> DataFrame:
    """Latest decisions for one ticker's company."""
    owner = (
        ticker_map.where(F.col("ticker") == ticker.upper())
        .join(securities.select("security_id", "company_id"), "security_id")
        .select("company_id")
    )
    return decisions.join(owner, "company_id", "left_semi").orderBy(
        F.col("evaluated_at").desc(), F.col("company_id"), F.col("exposure_name")
    ).limit(n)

"""Universe seeding, universe building, generated mappings, event features and exposure review as whole jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.identity import name_uuid, share_class
from returnlens.functions.parsing import midnight
from returnlens.functions.scoring import exposure_bucket
from returnlens.operators import events, exposures, peers, universe
from returnlens.operators.upsert import upsert

SEED_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "returnlens:universe-seed")
GENERATED_SOURCE = "generated_mapping"
GENERATED_VERSION = "generated_mapping_v0"
GENERATED_EXPOSURE_VERSION = "generated-exposure-v0"
DEFAULT_BASKET = "default_peer_basket"


def seed_id(kind: str, *parts: Column) -> Column:
    return name_uuid(SEED_NAMESPACE, F.concat_ws(":", F.lit(kind), *parts))


def seed_universe(listed: DataFrame, companies: DataFrame, curated: bool) -> dict[str, DataFrame]:
    """Companies, securities, tickers, members, classifications, baskets and exposures of a listed universe.

    A curated universe names its peers and exposures; any other takes the closest peers and sector heuristics.
    """
    known = companies.where(F.col("cik").isNotNull()).groupBy("cik").agg(
        F.min(F.col("company_id").cast("string")).alias("_known")
    )
    start = midnight(F.to_date("active_from"))
    rows = listed.join(known, "cik", "left").select(
        "*",
        F.coalesce("_known", seed_id("company", F.coalesce("cik", "ticker"))).alias("company_id"),
        seed_id("security", F.col("ticker")).alias("security_id"),
    )
    open_end = F.lit(None).cast("timestamp_ntz").alias("active_to")
    if curated:
        chosen = peers.listed_peers(rows, rows.select("ticker", "security_id"))
        listed_exposures = rows.select("company_id", "ticker", F.explode("exposures").alias("exposure_name", "exposure_value"))
        made = listed_exposures.withColumn("exposure_bucket", exposure_bucket(F.col("exposure_value")))
    else:
        chosen = peers.close_peers(rows)
        made = exposures.heuristic_exposures(rows, "seed-mapping-v0", "seed-exposure-v0")
    return {
        "company": rows.select("company_id", "cik", F.col("name").alias("legal_name")).dropDuplicates(["company_id"]),
        "security": rows.select(
            "security_id", "company_id", "exchange", share_class(F.col("ticker")).alias("share_class"),
            start.alias("active_from"), open_end,
        ),
        "ticker_history": rows.select(
            seed_id("ticker", F.col("ticker"), F.lit("current")).alias("ticker_history_id"),
            "security_id", "ticker", start.alias("active_from"), open_end,
        ),
        "member": rows.select(
            seed_id("member", F.col("version"), F.col("ticker")).alias("member_id"),
            "security_id", "company_id", "ticker", "version", "source", F.lit("eligible").alias("eligibility_status"),
        ),
        "classification": rows.select(
            "security_id", "ticker", "sector", "industry", "subindustry", F.to_date("active_from").alias("event_date")
        ),
        "basket_member": chosen.select("target_security_id", "ticker", "peer_security_id", "peer_ticker", "weight"),
        "exposure": made.select("company_id", "ticker", "exposure_name", "exposure_value", "exposure_bucket"),
    }


def build_universe(
    assets: DataFrame, history: DataFrame, bars: DataFrame, stored: DataFrame, source: str | None, min_bars: int = 2
) -> DataFrame:
    """Stored members with every eligible asset written over them."""
    found = universe.eligible_members(assets, history, universe.price_coverage(bars, source), min_bars)
    fresh = found.select(
        "security_id",
        F.col("canonical_ticker").alias("ticker"),
        "eligibility_status",
        "first_price_date",
        "last_price_date",
        "price_bar_count",
    )
    return upsert(stored, fresh, ["security_id"], [F.col("ticker").asc()])


def seed_mappings(
    candidates: DataFrame, classes: DataFrame, baskets: DataFrame, held_exposures: DataFrame,
    max_peers: int = 20, min_peers: int = 3,
) -> dict[str, DataFrame]:
    """Generated classifications, exposures and peer baskets, only where nothing curated exists."""
    classified = universe.unmapped(candidates, classes).select(
        seed_id("classification", F.lit(GENERATED_VERSION), F.col("ticker")).alias("classification_id"),
        "security_id",
        "sector",
        "industry",
        F.lit(GENERATED_SOURCE).alias("classification_source"),
        F.col("first_price_date").alias("event_date"),
    )
    made = universe.without_curated_exposure(
        exposures.sector_macro_exposures(candidates), held_exposures, GENERATED_EXPOSURE_VERSION
    )
    open_targets = universe.without_curated_basket(candidates, baskets, GENERATED_SOURCE).select(
        F.col("security_id").alias("target_security_id")
    )
    chosen = peers.liquid_peers(candidates, max_peers, min_peers).join(open_targets, "target_security_id", "left_semi")
    members = chosen.withColumn("peer_basket_id", seed_id("peer-basket", F.lit(GENERATED_VERSION), F.col("ticker")))
    return {
        "classification": classified,
        "exposure": made,
        "basket": members.select(
            "peer_basket_id",
            "target_security_id",
            F.lit(DEFAULT_BASKET).alias("basket_name"),
            F.lit(GENERATED_VERSION).alias("basket_version"),
            F.lit(GENERATED_SOURCE).alias("source"),
        ).distinct(),
        "basket_member": members.select("peer_basket_id", "target_security_id", "peer_security_id", "weight"),
    }


def refresh_event_features(event_rows: DataFrame, stored: DataFrame, source: str) -> DataFrame:
    """Feature rows of one official source's events, such as promoted filings, written over the stored ones."""
    official = [*events.OFFICIAL_SOURCES, source]
    fresh = events.event_features(event_rows.where(F.col("source") == source), official)
    return upsert(stored, fresh, ["event_id", "model_version"], [F.col("timestamp_available").desc()])


def review_exposures(
    features: DataFrame, event_rows: DataFrame, evaluated_at: str, lookback_days: int
) -> tuple[DataFrame, DataFrame]:
    """Decisions over the recent features and the events behind each."""
    recent = exposures.recent_features(features, event_rows, evaluated_at, lookback_days)
    decisions = exposures.exposure_decisions(recent, evaluated_at)
    return decisions, exposures.decision_evidence(recent, decisions)

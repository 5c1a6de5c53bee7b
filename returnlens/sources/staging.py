"""Source tables to staged rows, and staged rows to identities and price bars."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.identity import canonical_ticker, md5_uuid, name_uuid, normalize_cik
from returnlens.functions.parsing import json_payload, midnight
from returnlens.operators.pit import active_ticker_map, top_rows
from returnlens.operators.quality import issues

STAGING_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "returnlens:staging")
# Closes a stored price can hold.
MIN_CLOSE, MAX_CLOSE = 1e-6, 1e12


def stable_id(prefix: str, value: Column) -> Column:
    return name_uuid(STAGING_NAMESPACE, F.concat(F.lit(f"{prefix}:"), value.cast("string")))


def _tickers(df: DataFrame) -> dict[str, Column]:
    source = F.upper("ticker")
    return {"source_ticker": source, "canonical_ticker": canonical_ticker(source)}


def stage_assets(raw: DataFrame) -> DataFrame:
    """Asset rows with a name fallback chain and a three-letter currency, dollars by default."""
    names = _tickers(raw)
    currency = F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD"))
    company = F.coalesce(*[F.nullif(c, F.lit("")) for c in ("company_name_en", "company_name_ko", "ticker_display")])
    return raw.select(
        stable_id("asset", names["source_ticker"]).alias("asset_id"),
        *[c.alias(n) for n, c in names.items()],
        company.alias("company_name"),
        "asset_type",
        "exchange",
        "market",
        F.upper(F.substring(currency, 1, 3)).alias("currency"),
        "is_active",
        json_payload(raw).alias("raw_payload"),
    )


def stage_companies(raw: DataFrame) -> DataFrame:
    names = _tickers(raw)
    return raw.select(
        stable_id("company", names["source_ticker"]).alias("staged_company_id"),
        *[c.alias(n) for n, c in names.items()],
        normalize_cik(F.col("cik")).alias("cik"),
        "sector",
        "industry",
        json_payload(raw).alias("raw_payload"),
    )


def usable_close(close: Column) -> Column:
    return close.isNotNull() & ~F.isnan(close) & (close < float("inf")) & (close > 0)


def stage_prices(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged prices, and issue rows for those whose close is not a positive finite number."""
    names = _tickers(raw)
    good = usable_close(F.col("close"))
    staged = raw.where(good).select(
        stable_id("price", F.col("id")).alias("staged_price_id"),
        F.col("id").alias("source_price_id"),
        *[c.alias(n) for n, c in names.items()],
        "price_date",
        "close",
        "volume",
        F.lit("USD").alias("currency"),
    )
    refused = issues(
        raw.where(~F.coalesce(good, F.lit(False))),
        "error",
        "price_rejected",
        "prices",
        F.col("id"),
        F.format_string("non-positive close for source price %d", F.col("id")),
    )
    return staged, refused


def stage_rows(raw: DataFrame, prefix: str, date_column: str, extra: list[str] | None = None) -> DataFrame:
    """Any other source table: id, tickers, its date, chosen text columns and the whole row as JSON."""
    names = _tickers(raw)
    return raw.select(
        stable_id(prefix, F.col("id")).alias("staged_id"),
        F.col("id").alias("source_id"),
        *[c.alias(n) for n, c in names.items()],
        F.col(date_column).cast("date").alias(date_column),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in extra or []],
        json_payload(raw).alias("raw_payload"),
    )


def correct_currency(prices: DataFrame, assets: DataFrame) -> DataFrame:
    """Prices in the currency of their asset; prices without an asset keep theirs."""
    owner = assets.select(
        "source_ticker", F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")).alias("_currency")
    )
    joined = prices.join(owner, "source_ticker", "left")
    return joined.withColumn("currency", F.coalesce("_currency", "currency")).drop("_currency")


def source_inventory(tables: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows, date span and distinct tickers of each source table; spans only where a date column is named."""
    rows = []
    for name, (df, day) in tables.items():
        none = F.lit(None)
        rows.append(
            df.agg(
                F.count("*").alias("rows"),
                (F.min(F.col(day)).cast("date") if day else F.max(none).cast("date")).alias("min_date"),
                (F.max(F.col(day)).cast("date") if day else F.max(none).cast("date")).alias("max_date"),
                (F.count_distinct("ticker") if day else F.max(none).cast("long")).alias("tickers"),
            ).select(F.lit(name).alias("source_table"), "rows", "min_date", "max_date", "tickers")
        )
    return reduce(DataFrame.unionByName, rows)


def first_price_dates(prices: DataFrame) -> DataFrame:
    return prices.groupBy("canonical_ticker").agg(F.min("price_date").alias("first_price_date"))


def promote_prices(prices: DataFrame, history: DataFrame, source: str, imported_at: str) -> DataFrame:
    """Staged prices inside the storable range as bars of their ticker's active security, one per day."""
    owner = active_ticker_map(history).select(F.col("ticker").alias("canonical_ticker"), "security_id")
    at = F.lit(imported_at).cast("timestamp_ntz")
    kept = prices.where((F.col("close") >= MIN_CLOSE) & (F.col("close") < MAX_CLOSE)).join(owner, "canonical_ticker")
    bars = kept.select(
        md5_uuid(F.lit(source), F.col("security_id"), F.col("price_date")).alias("price_bar_id"),
        "security_id",
        F.col("price_date").alias("event_date"),
        "close",
        F.col("close").alias("adjusted_close"),
        "volume",
        F.coalesce(F.nullif("currency", F.lit("")), F.lit("USD")).alias("currency"),
        F.lit(source).alias("source"),
        at.alias("ingestion_time"),
        at.alias("timestamp_available"),
        F.col("source_price_id").alias("_source_id"),
    )
    return top_rows(bars, ["security_id", "event_date"], [F.col("_source_id").desc()]).drop("_source_id")


def promote_identities(
    assets: DataFrame,
    staged_companies: DataFrame,
    prices: DataFrame,
    companies: DataFrame,
    history: DataFrame,
    imported_at: str,
) -> tuple[DataFrame, DataFrame]:
    """New companies, and new securities with their ticker, from staged assets.

    A company is recognised by its registry number, else by ticker; a security is made only for tickers that lead
    to none yet.
    """
    numbers = staged_companies.select("source_ticker", "cik")
    known = companies.where(F.col("cik").isNotNull()).groupBy("cik").agg(F.min("company_id").alias("_known_company"))
    key = F.when(F.col("cik").isNotNull(), F.concat(F.lit("cik:"), "cik")).otherwise(
        F.concat(F.lit("ticker:"), "canonical_ticker")
    )
    named = (
        assets.join(numbers, "source_ticker", "left")
        .withColumn("company_key", key)
        .join(known, "cik", "left")
        .withColumn("company_id", F.coalesce(F.col("_known_company").cast("string"), stable_id("company", F.col("company_key"))))
    )
    fresh = named.where(F.col("_known_company").isNull())
    new_companies = top_rows(fresh, ["company_key"], [F.col("canonical_ticker").asc()]).select(
        "company_id", "cik", F.coalesce("company_name", "canonical_ticker").alias("legal_name")
    )
    mapped = history.where(F.col("active_to").isNull()).select(F.col("ticker").alias("canonical_ticker")).distinct()
    started = F.coalesce(midnight(F.col("first_price_date")), F.lit(imported_at).cast("timestamp_ntz"))
    unmapped = named.join(mapped, "canonical_ticker", "left_anti").join(
        first_price_dates(prices), "canonical_ticker", "left"
    )
    new_securities = top_rows(unmapped, ["canonical_ticker"], [F.col("source_ticker").asc()]).select(
        stable_id("security", F.col("canonical_ticker")).alias("security_id"),
        "company_id",
        F.col("canonical_ticker").alias("ticker"),
        F.coalesce(F.nullif("exchange", F.lit("")), F.nullif("market", F.lit("")), F.lit("UNKNOWN")).alias("exchange"),
        started.alias("active_from"),
    )
    return new_companies, new_securities


def ensure_identities(feed: DataFrame, companies: DataFrame, securities: DataFrame, history: DataFrame) -> DataFrame:
    """Company of every (cik, ticker, name) a feed brings, and what has to change for it.

    Matched by registry number, else through the ticker's active security, whose company then takes the number;
    otherwise a new company.
    """
    by_number = companies.where(F.col("cik").isNotNull()).select(
        "cik", F.col("company_id").alias("_by_cik"), F.col("legal_name").alias("_cik_name")
    )
    by_ticker = (
        active_ticker_map(history)
        .join(securities.select("security_id", "company_id"), "security_id")
        .join(companies.select("company_id", F.col("legal_name").alias("_ticker_name")), "company_id")
        .select("ticker", F.col("company_id").alias("_by_ticker"), "_ticker_name")
    )
    found = feed.join(by_number, "cik", "left").join(by_ticker, "ticker", "left")
    company = F.coalesce(F.col("_by_cik").cast("string"), F.col("_by_ticker").cast("string"), stable_id("feed_company", F.col("cik")))
    matched = F.when(F.col("_by_cik").isNotNull(), "cik").when(F.col("_by_ticker").isNotNull(), "ticker").otherwise("new")
    stored = F.coalesce("_cik_name", "_ticker_name")
    name = F.nullif("company_name", F.lit(""))
    return found.select(
        "cik",
        "ticker",
        company.alias("company_id"),
        matched.alias("matched_by"),
        F.coalesce(name, stored, "cik").alias("legal_name"),
        F.coalesce(name.isNotNull() & (stored != name), F.lit(False)).alias("name_changed"),
    )

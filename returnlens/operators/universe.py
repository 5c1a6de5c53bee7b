"""Universe eligibility, mapping candidates, summaries and the universe page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.identity import clean_label
from returnlens.functions.scoring import residual_usd
from returnlens.operators.assemble import driver_rank
from returnlens.operators.pit import active_ticker_map, close_at, latest_classification, top_rows
from returnlens.session import settle
from returnlens.vocab import RESIDUAL_DRIVER


def price_coverage(bars: DataFrame, source: str | None = None) -> DataFrame:
    counted = bars if source is None else bars.where(F.col("source") == source)
    return counted.groupBy("security_id").agg(
        F.count("*").alias("price_bar_count"),
        F.min("event_date").alias("first_price_date"),
        F.max("event_date").alias("last_price_date"),
    )


def is_active_dollar_stock() -> Column:
    return (
        (F.lower("asset_type") == "stock") & (F.upper("currency") == "USD") & F.coalesce("is_active", F.lit(False))
    )


def eligible_members(assets: DataFrame, history: DataFrame, coverage: DataFrame, min_bars: int) -> DataFrame:
    """Active dollar stocks whose open ticker leads to a security with enough price bars."""
    open_tickers = history.where(F.col("active_to").isNull()).select(
        F.col("ticker").alias("canonical_ticker"), "security_id"
    )
    covered = coverage.where(F.col("price_bar_count") >= min_bars)
    return (
        assets.where(is_active_dollar_stock())
        .join(open_tickers, "canonical_ticker")
        .join(covered, "security_id")
        .select("*", F.lit("eligible").alias("eligibility_status"))
    )


def member_coverage(members: DataFrame, bars: DataFrame) -> DataFrame:
    """Members with their price coverage; a member without bars keeps a zero count and a skip reason."""
    counted = members.join(price_coverage(bars), "security_id", "left")
    n = F.coalesce("price_bar_count", F.lit(0))
    return counted.withColumns(
        {
            "price_bar_count": n,
            "eligibility_status": F.when(n > 0, "eligible").otherwise("missing_prices"),
            "skip_reason": F.when(n == 0, "missing_price_bars"),
        }
    )


def mapping_candidates(members: DataFrame, companies: DataFrame) -> DataFrame:
    """Members with cleaned sector and industry of the staged company of the same ticker, if any."""
    labels = companies.select(
        F.col("canonical_ticker").alias("ticker"),
        clean_label(F.col("sector")).alias("sector"),
        clean_label(F.col("industry")).alias("industry"),
    )
    return members.join(labels, "ticker", "left")


def unmapped(candidates: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates with a sector and no classification yet."""
    return candidates.where(F.col("sector").isNotNull()).join(
        classes.select("security_id").distinct(), "security_id", "left_anti"
    )


def without_curated_basket(targets: DataFrame, baskets: DataFrame, generated_source: str) -> DataFrame:
    curated = baskets.where(F.col("source") != generated_source).select(
        F.col("target_security_id").alias("security_id")
    ).distinct()
    return targets.join(curated, "security_id", "left_anti")


def without_curated_exposure(generated: DataFrame, exposures: DataFrame, generated_version: str) -> DataFrame:
    curated = exposures.where(F.col("model_version") != generated_version).select("company_id", "exposure_name").distinct()
    return generated.join(curated, ["company_id", "exposure_name"], "left_anti")


def latest_runs(runs: DataFrame, cadence: str = "daily", by_window: bool = True) -> DataFrame:
    """Newest run per security: by window end for summaries, by creation for the latest-run lookup."""
    order = [F.col("created_at").desc(), F.col("window_end").desc(), F.col("attribution_run_id").asc()]
    if by_window:
        order = [F.col("window_end").desc(), F.col("created_at").desc(), F.col("attribution_run_id").asc()]
    return top_rows(runs.where(F.col("cadence") == cadence), ["security_id"], order)


def summaries(
    members: DataFrame, runs: DataFrame, parts: DataFrame, classes: DataFrame, bars: DataFrame, cutoff: str
) -> DataFrame:
    """One row per universe member: newest daily run, its top driver, counts and price change.

    The newest runs and what is read of their contributions are written first: contributions are read once, and of the
    evidence only whether there is any goes further.
    """
    newest = latest_runs(runs).select(
        "security_id",
        F.col("attribution_run_id").alias("latest_run_id"),
        "window_start",
        "window_end",
        F.col("observed_return_bps").alias("latest_observed_return_bps"),
        F.col("unexplained_residual_bps").alias("latest_residual_bps"),
    )
    latest = settle(newest, "latest-runs")
    has_evidence = (F.size("evidence") > 0) | (F.col("evidence_payload") != "{}")
    told = parts.select("attribution_run_id", "driver", "name", "contribution_bps", "confidence", has_evidence.alias("has_evidence"))
    mine = settle(told.join(latest.select(F.col("latest_run_id").alias("attribution_run_id")), "attribution_run_id"), "latest-contributions")
    counts = mine.groupBy(F.col("attribution_run_id").alias("latest_run_id")).agg(
        F.count("*").alias("contribution_count"), F.count_if("has_evidence").alias("evidence_count")
    )
    top = top_rows(
        mine.where(F.col("driver") != RESIDUAL_DRIVER),
        ["attribution_run_id"],
        [F.abs("contribution_bps").desc(), driver_rank(F.col("driver")).asc(), F.col("name").asc()],
    ).select(
        F.col("attribution_run_id").alias("latest_run_id"),
        F.col("name").alias("top_driver"),
        F.col("confidence").alias("top_driver_confidence"),
    )
    edges = latest.select("security_id", F.explode(F.array("window_start", "window_end")).alias("event_date"))
    closes = close_at(edges.distinct(), bars, "event_date", cutoff, "close")
    at = lambda day, name: closes.select("security_id", F.col("event_date").alias(day), F.col("close").alias(name))
    priced = latest.join(at("window_start", "start_close"), ["security_id", "window_start"], "left").join(
        at("window_end", "end_close"), ["security_id", "window_end"], "left"
    )
    labels = latest_classification(classes).select("security_id", "sector", "industry")
    zero = F.lit(0)
    return (
        members.join(priced, "security_id", "left")
        .join(counts, "latest_run_id", "left")
        .join(top, "latest_run_id", "left")
        .join(labels, "security_id", "left")
        .select(
            "security_id",
            "ticker",
            "company_id",
            "company_name",
            "exchange",
            "sector",
            "industry",
            "latest_run_id",
            F.col("window_start").alias("latest_window_start"),
            F.col("window_end").alias("latest_window_end"),
            "latest_observed_return_bps",
            "latest_residual_bps",
            (F.col("end_close") - F.col("start_close")).alias("latest_price_change_usd"),
            "top_driver",
            "top_driver_confidence",
            F.coalesce("contribution_count", zero).alias("contribution_count"),
            F.coalesce("evidence_count", zero).alias("evidence_count"),
            F.when(F.col("latest_run_id").isNotNull(), "available").otherwise("missing").alias("run_status"),
        )
    )


def refreshed_summaries(
    stored: DataFrame, members: DataFrame, delta_runs: DataFrame, delta_parts: DataFrame, classes: DataFrame, bars: DataFrame, cutoff: str
) -> DataFrame:
    """``stored`` summaries brought up to date by runs written since, as a full refresh over all runs would give.

    A run of the delta replaces a security's summary if its window ends no earlier than the stored one: runs written later
    win at equal ends. Only those securities read runs, contributions and closes; the others keep their row, with the
    members' names and classes as they are now.
    """
    latest = latest_runs(delta_runs).select("security_id", F.col("attribution_run_id").alias("newer_run_id"), "window_end")
    known = stored.select("security_id", "latest_window_end")
    newer = latest.join(known, "security_id", "left").where(
        F.col("latest_window_end").isNull() | (F.col("window_end") >= F.col("latest_window_end"))
    )
    moved = members.join(newer, "security_id", "left_semi")
    runs = delta_runs.join(newer.select(F.col("newer_run_id").alias("attribution_run_id")), "attribution_run_id", "left_semi")
    fresh = summaries(moved, runs, delta_parts, classes, bars, cutoff)
    labels = latest_classification(classes).select("security_id", "sector", "industry")
    named = [c for c in members.columns if c in stored.columns and c != "security_id"]
    held = stored.drop("sector", "industry", *named).join(newer, "security_id", "left_anti")
    kept = members.join(newer, "security_id", "left_anti").join(held, "security_id", "left").join(labels, "security_id", "left")
    zero = F.lit(0)
    kept = kept.withColumns({
        "contribution_count": F.coalesce("contribution_count", zero), "evidence_count": F.coalesce("evidence_count", zero),
        "run_status": F.coalesce("run_status", F.lit("missing")),
    })
    return fresh.unionByName(kept.select(*fresh.columns))


# Sort names of the universe page and the summary column behind each.
PAGE_SORTS = {
    "ticker": "ticker",
    "company": "company_name",
    "exchange": "exchange",
    "sector": "sector",
    "industry": "industry",
    "latest_run": "latest_window_end",
    "move": "latest_observed_return_bps",
    "residual": "latest_residual_bps",
    "status": "run_status",
    "top_driver": "top_driver",
    "confidence": "top_driver_confidence",
    "contributions": "contribution_count",
    "evidence": "evidence_count",
}


def filter_universe(
    rows: DataFrame,
    search: str | None = None,
    sector: str | None = None,
    industry: str | None = None,
    exchange: str | None = None,
    status: str | None = None,
) -> DataFrame:
    """Search text matches ticker or company name; percent and underscore in it act as wildcards."""
    if search:
        pattern = f"%{search.upper()}%"
        rows = rows.where(F.upper("ticker").like(pattern) | F.upper("company_name").like(pattern))
    if sector:
        rows = rows.where(F.col("sector") == sector)
    if industry:
        rows = rows.where(F.col("industry") == industry)
    if exchange:
        rows = rows.where(F.upper("exchange") == exchange.upper())
    if status in ("available", "missing"):
        rows = rows.where(F.col("run_status") == status)
    return rows


def universe_page(rows: DataFrame, sort: str = "ticker", descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    by = F.col(PAGE_SORTS.get(sort, "ticker"))
    order = by.desc_nulls_last() if descending else by.asc_nulls_last()
    usd = residual_usd(
        F.col("latest_residual_bps"), F.col("latest_observed_return_bps"), F.col("latest_price_change_usd")
    )
    return (
        rows.withColumn("latest_residual_usd", usd)
        .withColumn("has_evidence", F.col("evidence_count") > 0)
        .orderBy(order, F.col("ticker").asc())
        .offset(offset)
        .limit(limit)
    )


def page_total(rows: DataFrame) -> DataFrame:
    """How many rows the pages of a filtered universe hold together."""
    return rows.agg(F.count("*").alias("total"))


def universe_options(rows: DataFrame) -> DataFrame:
    """Distinct values offered by the page's filters, one row each."""
    options = F.explode(
        F.array(
            F.struct(F.lit("sector").alias("kind"), F.col("sector").alias("value"), F.lit(None).cast("string").alias("label")),
            F.struct(F.lit("industry").alias("kind"), F.col("industry").alias("value"), F.lit(None).cast("string").alias("label")),
            F.struct(F.lit("exchange").alias("kind"), F.col("exchange").alias("value"), F.lit(None).cast("string").alias("label")),
            F.struct(F.lit("company").alias("kind"), F.col("ticker").alias("value"), F.col("company_name").alias("label")),
        )
    )
    spread = rows.select(options.alias("o")).select("o.*")
    return spread.where(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


def dedupe_by_ticker(rows: DataFrame) -> DataFrame:
    """Best row per ticker: with a run, then newest window, then with sector, then with industry."""

    def filled(name: str) -> Column:
        return F.coalesce(F.col(name) != "", F.lit(False))

    return top_rows(
        rows,
        ["ticker"],
        [
            F.col("latest_run_id").isNotNull().desc(),
            F.col("latest_window_end").desc_nulls_last(),
            filled("sector").desc(),
            filled("industry").desc(),
            F.col("security_id").asc(),
        ],
    )


def first_alias_with_rows(wanted: DataFrame, rows: DataFrame, ticker: str = "ticker") -> DataFrame:
    """For each security the first spelling, in order, under which any row exists, with all its rows."""
    tried = wanted.select("security_id", F.posexplode("attempts").alias("attempt", ticker))
    present = tried.join(rows.select(ticker).distinct(), ticker, "left_semi")
    chosen = top_rows(present, ["security_id"], [F.col("attempt").asc()])
    return chosen.join(rows, ticker)


def active_security_of(runs: DataFrame, history: DataFrame) -> DataFrame:
    """Runs with the ticker their security trades under now."""
    names = active_ticker_map(history).groupBy("security_id").agg(F.min("ticker").alias("ticker"))
    return runs.join(names, "security_id", "left")

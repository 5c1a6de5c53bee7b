"""Queries over whole jobs and point lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from returnlens.catalog.core import seen_bars
from returnlens.catalog.panels import Panels
from returnlens.catalog.registry import ORACLES, query
from returnlens.catalog.runs import METRICS_SQL, fixed, shown_metrics, stored
from returnlens.operators import events, reports, universe, windows
from returnlens.operators.pit import active_ticker_map
from returnlens.plans import mapping
from returnlens.sources import staging


def listed(p: Panels):
    n = F.col("security_id")
    name = lambda k: F.concat(F.lit("NATION_"), ((n + k) % 25).cast("string"))
    return p.security.select(
        F.lit("v0").alias("version"),
        F.lit("panel").alias("source"),
        F.lit("1995-01-01").alias("active_from"),
        "ticker",
        F.col("legal_name").alias("name"),
        "cik",
        "exchange",
        "sector",
        "industry",
        "subindustry",
        F.array(name(0), name(1), F.lit("GHOST")).alias("peers"),
        F.create_map(F.lit("rates"), (n / 25).cast("double")).alias("exposures"),
    )


def seed_view(tables):
    text = lambda c: F.format_string("%.4f", c)
    return (
        tables["member"]
        .select(F.lit("member").alias("kind"), "ticker", F.col("eligibility_status").alias("value"))
        .unionByName(tables["classification"].select(F.lit("class").alias("kind"), "ticker", F.col("industry").alias("value")))
        .unionByName(tables["basket_member"].select(F.lit("peer").alias("kind"), "ticker", F.col("peer_ticker").alias("value")))
        .unionByName(
            tables["exposure"].select(
                F.lit("exposure").alias("kind"), "ticker", F.concat_ws("=", "exposure_name", text("exposure_value")).alias("value")
            )
        )
    )


@query("seeded_universe", """
SELECT 'member' AS kind, ticker, 'eligible' AS value FROM security
UNION ALL SELECT 'class', ticker, industry FROM security
UNION ALL SELECT 'peer', t.ticker, p.ticker FROM security t JOIN security p ON p.ticker <> t.ticker AND (p.sector = t.sector OR p.subindustry = t.subindustry)
UNION ALL SELECT 'exposure', ticker, unnest(['rates=0.5000', 'credit=0.3500', 'inflation=0.3500']) FROM security""")
def seeded_universe(p: Panels):
    return seed_view(mapping.seed_universe(listed(p), p.security, curated=False))


@query("seeded_curated_universe", """
SELECT 'member' AS kind, ticker, 'eligible' AS value FROM security
UNION ALL SELECT 'class', ticker, industry FROM security
UNION ALL SELECT 'peer', t.ticker, p.ticker FROM security t JOIN security p ON p.security_id = (t.security_id + 1) % 25
UNION ALL SELECT 'exposure', ticker, concat('rates=', format('{:.4f}', security_id / 25)) FROM security""")
def seeded_curated_universe(p: Panels):
    return seed_view(mapping.seed_universe(listed(p), p.security, curated=True))


@query("built_universe", """
SELECT h.security_id, upper(a.ticker) AS ticker, c.price_bar_count FROM asset a JOIN ticker_history h ON h.ticker = upper(a.ticker) AND h.active_to IS NULL
JOIN coverage c ON c.security_id = h.security_id
WHERE lower(a.asset_type) = 'stock' AND upper(substr(coalesce(a.currency, 'USD'), 1, 3)) = 'USD' AND a.is_active AND c.price_bar_count >= 2
UNION ALL SELECT 900 + security_id, ticker, 0 FROM security""")
def built_universe(p: Panels):
    old = p.security.select(
        (F.col("security_id") + 900).alias("security_id"),
        "ticker",
        F.lit("eligible").alias("eligibility_status"),
        F.lit(None).cast("date").alias("first_price_date"),
        F.lit(None).cast("date").alias("last_price_date"),
        F.lit(0).cast("long").alias("price_bar_count"),
    )
    made = mapping.build_universe(staging.stage_assets(p.asset), p.ticker_history, seen_bars(p), old, None)
    return made.select("security_id", "ticker", "price_bar_count")


@query("seeded_mappings", """
SELECT 'classification' AS kind, security_id AS owner, coalesce(industry, '') AS value FROM candidates WHERE security_id % 5 <> 0
UNION ALL SELECT 'exposure', company_id, unnest(['rates', 'credit', 'inflation']) FROM candidates WHERE company_id % 6 <> 0
UNION ALL SELECT 'exposure', company_id, unnest(['credit', 'inflation']) FROM candidates WHERE company_id % 6 = 0
UNION ALL SELECT 'peer', t.security_id, p.ticker FROM candidates t JOIN candidates p ON p.security_id <> t.security_id AND p.sector = t.sector
WHERE t.security_id % 4 <> 0""")
def seeded_mappings(p: Panels):
    c = p.candidates
    baskets = p.peer_basket.withColumn(
        "source", F.when(F.col("target_security_id") % 4 == 0, "curated").otherwise(mapping.GENERATED_SOURCE)
    )
    held = c.select("company_id", F.lit("rates").alias("exposure_name"), F.lit("curated").alias("model_version")).where("company_id % 6 = 0")
    made = mapping.seed_mappings(c, p.classification.where("security_id % 5 = 0"), baskets, held)
    names = c.select(F.col("security_id").alias("peer_security_id"), "ticker")
    return (
        made["classification"]
        .select(F.lit("classification").alias("kind"), F.col("security_id").alias("owner"), F.coalesce("industry", F.lit("")).alias("value"))
        .unionByName(made["exposure"].select(F.lit("exposure").alias("kind"), F.col("company_id").alias("owner"), F.col("exposure_name").alias("value")))
        .unionByName(
            made["basket_member"].join(names, "peer_security_id").select(
                F.lit("peer").alias("kind"), F.col("target_security_id").alias("owner"), F.col("ticker").alias("value")
            )
        )
    )


@query("refreshed_event_features", """
SELECT event_id, relevance, CAST(source_credibility AS DOUBLE) AS source_credibility FROM features
WHERE evidence_span LIKE 'source=sec_edgar;%' OR event_id % 2 = 0""")
def refreshed_event_features(p: Panels):
    old = events.event_features(p.event.where("event_id % 2 = 0"))
    made = mapping.refresh_event_features(p.event, old, "sec_edgar")
    return made.select("event_id", "relevance", "source_credibility")


@query("exposure_review_job", """
SELECT company_id, exposure_name, event_id, CASE WHEN reviews >= 2 OR highs > 0 THEN 'candidate_review' ELSE 'no_update' END AS decision FROM (
  SELECT *, count(*) FILTER (WHERE review) OVER (PARTITION BY company_id, exposure_name) AS reviews,
         count(*) FILTER (WHERE high) OVER (PARTITION BY company_id, exposure_name) AS highs,
         row_number() OVER (PARTITION BY company_id, exposure_name ORDER BY timestamp_available, event_id) AS rn FROM exposure_votes) v
WHERE review OR (reviews = 0 AND rn <= 3)""")
def exposure_review_job(p: Panels):
    decisions, evidence = mapping.review_exposures(events.event_features(p.event), p.event, "2000-01-20 00:00:00", 5)
    keys = ["company_id", "exposure_name"]
    return evidence.join(decisions.select(*keys, "decision"), keys).select(*keys, "event_id", "decision")


@query("run_lookup", """
SELECT h.ticker, r.window_start, r.window_end, c.driver, CAST(round(CAST(c.contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps
FROM (SELECT * FROM win WHERE security_id = 3 AND cadence = 'weekly' ORDER BY window_end DESC LIMIT 1) r
JOIN (SELECT * FROM part_expanded WHERE security_id = 3 AND cadence = 'weekly') c ON c.window_start = r.window_start AND c.window_end = r.window_end
JOIN (SELECT ticker, security_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY active_from DESC, security_id) AS rn
      FROM ticker_history WHERE active_to IS NULL) t WHERE rn = 1) h ON h.security_id = r.security_id""")
def run_lookup(p: Panels):
    """Latest weekly run of one ticker with its contributions."""
    runs, parts = stored(p)
    owner = active_ticker_map(p.ticker_history).where("ticker = 'NATION_3'").select("security_id")
    latest = universe.latest_runs(runs.join(owner, "security_id", "left_semi"), "weekly", by_window=False)
    found = universe.active_security_of(reports.run_details(latest, parts), p.ticker_history)
    return found.select("ticker", "window_start", "window_end", "driver", fixed("contribution_bps", 6, 3))


@query("coverage_success", """
SELECT min(CASE WHEN hits / total >= 0.5 THEN 1 ELSE 0 END) = 1 AS success FROM (
  SELECT a.cadence, count(*) AS total, count(w.security_id) AS hits FROM all_windows a LEFT JOIN win w ON w.security_id = a.security_id
   AND w.cadence = a.cadence AND w.window_start = a.window_start AND w.window_end = a.window_end GROUP BY a.cadence) x""")
def coverage_success(p: Panels):
    report = reports.coverage_report(windows.build_windows(seen_bars(p)), stored(p, expanded=False)[0], 0.5)
    return reports.coverage_success(report)


@query("metrics_file", METRICS_SQL)
def metrics_file(p: Panels):
    """Methodology metrics written as JSON and read back."""
    from returnlens.session import scratch_path

    path = scratch_path(p.spark, "metrics")
    metrics = reports.methodology_metrics(*stored(p))
    reports.write_metrics(metrics, path)
    return shown_metrics(p.spark.read.schema(metrics.schema).json(path))


@query("promoted_filing_features", """
SELECT accession_number AS source_id, CAST(1.0 AS DOUBLE) AS source_credibility
FROM chosen_filings f JOIN (SELECT ticker, security_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY active_from DESC, security_id) AS rn
      FROM ticker_history WHERE active_to IS NULL) t WHERE rn = 1) h ON h.ticker = f.chosen JOIN security s ON s.security_id = h.security_id""")
def promoted_filing_features(p: Panels):
    """Features of promoted filings, whose source counts as official."""
    from returnlens.catalog.ingest import checked
    from returnlens.sources import filings

    good = filings.valid(checked(p))
    promoted = filings.promote_filings(filings.choose_filings(good), filings.accession_aliases(good), p.security, p.ticker_history, "filings")
    made = mapping.refresh_event_features(promoted, events.event_features(promoted).limit(0), "filings")
    named = F.regexp_extract("evidence_span", "accession=(.*)$", 1)
    return made.select(named.alias("source_id"), F.col("source_credibility").cast("double").alias("source_credibility"))


@query("monthly_price_store", """
SELECT security_id, event_date, source, round(CASE WHEN event_date >= DATE '1998-01-01' THEN close * 2 ELSE close END, 6) AS close FROM price_raw""")
def monthly_price_store(p: Panels):
    """A table written by month, months of it merged over and published again, a write left unpublished, and read back."""
    return price_store(p).read().select("security_id", "event_date", "source", F.round("close", 6).alias("close"))


@query("deep_run_page", """
SELECT position, security_id, cadence, window_start, window_end, observed_return_bps FROM (
  SELECT row_number() OVER (ORDER BY window_end DESC, security_id, cadence, window_start) - 1 AS position, security_id, cadence, window_start, window_end,
         round(observed_return_bps, 4) AS observed_return_bps, count(*) OVER () AS total FROM win) r
WHERE position >= total * 3 // 5 AND position < total * 3 // 5 + 50""")
def deep_run_page(p: Panels):
    """Fifty runs from three fifths down the list of all, newest first."""
    from returnlens.operators.paging import Pages

    runs, _ = stored(p, expanded=False)
    order = [F.col("window_end").desc(), F.col("security_id").asc(), F.col("cadence").asc(), F.col("window_start").asc()]
    pages = Pages(runs.select(*windows.WINDOW, F.round("observed_return_bps", 4).alias("observed_return_bps")), order)
    return pages.page(pages.total * 3 // 5, 50)


@query("price_snapshots", """
SELECT v.version, security_id, event_date, source, round(CASE WHEN v.version = 2 AND event_date >= DATE '1998-01-01' THEN close * 2 ELSE close END, 6) AS close
FROM price_raw CROSS JOIN (VALUES (1), (2)) v(version)""")
def price_snapshots(p: Panels):
    """Both published versions of the store, read after the second."""
    store = price_store(p)
    shown = lambda v: store.read(v).select(F.lit(v).alias("version"), "security_id", "event_date", "source", F.round("close", 6).alias("close"))
    return shown(1).unionByName(shown(2))


def price_store(p: Panels):
    from returnlens.operators.snapshots import SnapshotStore
    from returnlens.session import scratch_path

    store = SnapshotStore(p.spark, scratch_path(p.spark, "prices"))
    key, newest = ["security_id", "event_date", "source"], [F.col("timestamp_available").desc()]
    store.merge(p.price_raw, key, newest)
    doubled = p.price_raw.where("event_date >= DATE '1998-01-01'").withColumn("close", F.col("close") * 2)
    store.merge(doubled, key, newest)
    store.stage(doubled.withColumn("close", F.lit(0.0)))
    return store


@query("style_exposures", """
SELECT security_id, cadence, window_start, replace(replace(name, 'Style descriptor (', ''), ')', '') AS factor_name, window_end AS as_of, value AS exposure_value,
       observations FROM (""" + ORACLES["style_descriptors_window"] + """) d""")
def style_exposures(p: Panels):
    """Exposure rows of every window's style descriptors, with their values."""
    from returnlens.catalog.core import LOOKBACK, prepared
    from returnlens.operators import style

    ready = prepared(p)
    keys = ["security_id", "cadence", "window_start", "window_end", "observed_return_bps"]
    found = style.window_descriptors(ready.windows.select(*keys), ready.bars, LOOKBACK)
    as_of = F.col("window_end").cast("timestamp_ntz")
    rows = style.exposures_from_descriptors(found, as_of, keep=["cadence", "window_start"])
    return rows.select(
        "security_id", "cadence", "window_start", "factor_name", F.col("event_time").cast("date").alias("as_of"),
        F.round("exposure_value", 4).alias("exposure_value"), F.get_json_object("diagnostics", "$.observations").cast("long").alias("observations"),
    )

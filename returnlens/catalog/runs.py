"""Queries over whole attributions: residuals, shares, storage, reports and charts."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.catalog.core import market_data, prepared, seen_bars, settings
from returnlens.catalog.panels import CUTOFF, DUCK_NAMES, PANELS, Panels
from returnlens.catalog.registry import STEPS, query
from returnlens.catalog.steps import AT, LOOKBACK
from returnlens.operators import assemble, events, models, pit, quality, reports, universe, upsert, windows
from returnlens.plans import attribution as plan
from returnlens.plans import availability, backfill
from returnlens.session import settle
from returnlens.vocab import METHODOLOGIES

_built: dict[tuple, tuple] = {}


def stored(p: Panels, methodology: str = "legacy", expanded: bool = True):
    """Runs and contributions of one methodology, attributed once per application and read back."""
    key = (p.spark.sparkContext.applicationId, p.sf_dir, methodology, expanded)
    if key not in _built:
        _built[key] = plan.attribute(market_data(p), settings(methodology=methodology), expanded=expanded)
    return _built[key]


# ---- oracle side: contributions of the market-only and the expanded runs, then their stored form
STEPS["market_rows"] = """
SELECT security_id, cadence, window_start, window_end, observed_return_bps, driver, name, contribution_bps,
       'Medium' AS confidence, true AS has_evidence FROM fits_assigned_market_market"""

STEPS["event_hits"] = f"""
SELECT w.security_id, w.cadence, w.window_start, w.window_end, w.observed_return_bps, e.event_id, e.event_time,
       CASE WHEN e.event_type = '8-K' AND i.category IS NOT NULL THEN i.category ELSE coalesce(f.category, 'general_disclosure') END AS category,
       CASE WHEN e.event_type = '8-K' AND i.category IS NOT NULL THEN i.subtype ELSE coalesce(f.subtype, 'unclassified') END AS subtype
FROM win w JOIN security s ON s.security_id = w.security_id
JOIN event e ON e.company_id = s.company_id AND e.event_time >= w.window_start AND e.event_time <= w.window_end
  AND e.timestamp_available <= {AT}
LEFT JOIN (VALUES ('8-K', 'corporate_event', 'current_report'), ('10-K', 'periodic_results', 'annual_report'),
  ('10-Q', 'periodic_results', 'quarterly_report'), ('13G', 'ownership', 'passive_large_holder'),
  ('4', 'insider_activity', 'form_4')) f(form, category, subtype) ON f.form = upper(e.event_type)
LEFT JOIN (VALUES ('2.02', 'earnings', 'results_of_operations'), ('2.06', 'accounting', 'material_impairment'),
  ('5.02', 'management', 'officer_or_director_change'), ('7.01', 'disclosure', 'reg_fd'),
  ('9.01', 'disclosure', 'financial_statements_exhibits')) i(code, category, subtype)
  ON i.code = trim(coalesce(e.structured_payload ->> '$.item', e.structured_payload ->> '$.item_code',
                            e.structured_payload ->> '$.eight_k_item', e.structured_payload ->> '$."8k_item"'))"""

STEPS["style_hits"] = """
SELECT security_id, cadence, window_start, window_end, observed_return_bps,
       unnest(['momentum', 'short_term_reversal', 'realized_volatility', 'liquidity']) AS descriptor
FROM (SELECT w.security_id, w.cadence, w.window_start, w.window_end, w.observed_return_bps
      FROM win w JOIN bars b ON b.security_id = w.security_id AND b.event_date >= w.window_start - 252
       AND b.event_date <= w.window_end GROUP BY ALL HAVING count(*) >= 21) s"""

STEPS["expanded_rows"] = """
SELECT security_id, cadence, window_start, window_end, observed_return_bps, driver, name, contribution_bps FROM fits_five
UNION ALL SELECT security_id, cadence, window_start, window_end, observed_return_bps, driver, name, contribution_bps
FROM fits_assigned_sector
UNION ALL SELECT security_id, cadence, window_start, window_end, observed_return_bps, driver, name, contribution_bps
FROM fits_assigned_peer
UNION ALL SELECT security_id, cadence, window_start, window_end, observed_return_bps, driver, name, contribution_bps
FROM fits_assigned_macro
UNION ALL SELECT security_id, cadence, window_start, window_end, observed_return_bps, 'style',
  concat('Style descriptor (', descriptor, ')'), 0.0 FROM style_hits
UNION ALL SELECT security_id, cadence, window_start, window_end, observed_return_bps, 'event',
  concat('Event evidence (', category, '/', subtype, ')'), 0.0 FROM event_hits"""


def _totals(rows: str, tag: str) -> None:
    STEPS[f"totals_{tag}"] = f"""
SELECT w.security_id, w.cadence, w.window_start, w.window_end, w.observed_return_bps,
       w.observed_return_bps - coalesce(sum(r.contribution_bps), 0.0) AS residual_bps,
       coalesce(sum(abs(r.contribution_bps)), 0.0) AS gross_bps, coalesce(abs(sum(r.contribution_bps)), 0.0) AS net_bps,
       count(r.name) AS input_rows, count(*) FILTER (WHERE r.driver = 'event') AS events
FROM win w LEFT JOIN {rows} r ON r.security_id = w.security_id AND r.cadence = w.cadence
 AND r.window_start = w.window_start AND r.window_end = w.window_end
GROUP BY w.security_id, w.cadence, w.window_start, w.window_end, w.observed_return_bps"""
    STEPS[f"run_{tag}"] = f"""
SELECT security_id, cadence, window_start, window_end, round(observed_return_bps, 6) AS observed_return_bps,
       round(residual_bps, 6) AS unexplained_residual_bps, gross_bps, net_bps, input_rows, events FROM totals_{tag}"""
    STEPS[f"part_{tag}"] = f"""
SELECT r.security_id, r.cadence, r.window_start, r.window_end, r.driver, r.name,
       round(r.contribution_bps, 6) AS contribution_bps,
       round(r.contribution_bps / nullif(r.observed_return_bps, 0), 8) AS share_of_move
FROM {rows} r
UNION ALL
SELECT security_id, cadence, window_start, window_end, 'unexplained_residual', 'Unexplained residual',
       round(residual_bps, 6), round(residual_bps / nullif(observed_return_bps, 0), 8) FROM totals_{tag}"""


_totals("market_rows", "market")
_totals("expanded_rows", "expanded")


@query("market_attribution", """
SELECT security_id, cadence, window_start, window_end, round(observed_return_bps, 4) AS observed_return_bps, driver, name,
       round(contribution_bps, 4) AS contribution_bps, confidence FROM market_rows
UNION ALL
SELECT security_id, cadence, window_start, window_end, round(observed_return_bps, 4), 'unexplained_residual',
       'Unexplained residual', round(residual_bps, 4),
       CASE WHEN abs(residual_bps) > abs(observed_return_bps) * 0.5 THEN 'Low' ELSE 'Medium' END FROM totals_market""")
def market_attribution(p: Panels):
    ready = prepared(p)
    rows = plan.market_rows(market_data(p), settings(), ready)
    parts = assemble.contributions(ready.windows, rows, CUTOFF, False)
    return parts.select(
        *windows.WINDOW,
        F.round("observed_return_bps", 4).alias("observed_return_bps"),
        "driver",
        "name",
        F.round("contribution_bps", 4).alias("contribution_bps"),
        "confidence",
    )


@query("expanded_attribution_runs", """
SELECT security_id, cadence, window_start, window_end, round(observed_return_bps, 4) AS observed_return_bps,
       round(unexplained_residual_bps, 4) AS unexplained_residual_bps, 'factor-baseline-v0' AS model_version,
       'mvp_expanded_v0' AS factor_basket_version FROM (SELECT *, residual_bps AS unexplained_residual_bps FROM totals_expanded)""")
def expanded_attribution_runs(p: Panels):
    ready = prepared(p)
    rows = plan.expanded_rows(market_data(p), settings(), ready)
    parts = assemble.contributions(ready.windows, rows, CUTOFF, False)
    rest = parts.where("driver = 'unexplained_residual'")
    model, basket = METHODOLOGIES["legacy"]
    return rest.select(
        *windows.WINDOW,
        F.round("observed_return_bps", 4).alias("observed_return_bps"),
        F.round("contribution_bps", 4).alias("unexplained_residual_bps"),
        F.lit(model).alias("model_version"),
        F.lit(basket).alias("factor_basket_version"),
    )


def fixed(column: str, stored_at: int, shown: int):
    """Round a stored number through decimal, so that halves round alike everywhere."""
    return F.round(F.col(column).cast(f"decimal(24, {stored_at})"), shown).cast("double").alias(column)


def with_key(runs, parts):
    return parts.join(runs.select("attribution_run_id", *windows.WINDOW, "observed_return_bps"), "attribution_run_id")


def copies(runs, parts):
    """Contribution rows by window with how often each occurs."""
    shown = with_key(runs, parts).select(*windows.WINDOW, "driver", "name", fixed("contribution_bps", 6, 3))
    return shown.groupBy(*windows.WINDOW, "driver", "name", "contribution_bps").agg(F.count("*").alias("copies"))


@query("expanded_attribution_contributions", """
SELECT security_id, cadence, window_start, window_end, driver, name, CAST(round(CAST(contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps,
       count(*) AS copies FROM part_expanded GROUP BY ALL""")
def expanded_attribution_contributions(p: Panels):
    return copies(*stored(p))


@query("share_diagnostics", """
SELECT security_id, cadence, window_start, window_end, abs(observed_return_bps) >= 25 AS share_is_stable,
       round(gross_bps / greatest(abs(observed_return_bps), 25.0), 6) AS gross_contribution_leverage,
       round(net_bps / greatest(abs(observed_return_bps), 25.0), 6) AS net_explained_leverage,
       round(abs(residual_bps) / greatest(abs(observed_return_bps), 25.0), 6) AS residual_leverage,
       CASE WHEN abs(observed_return_bps) >= 25 THEN 'stable' ELSE 'unstable_small_observed_move' END AS share_display_status,
       CASE WHEN abs(residual_bps) > 0.5 * greatest(abs(observed_return_bps), 25.0) THEN 'Low' ELSE 'Medium' END AS safe_confidence
FROM totals_market""")
def share_diagnostics(p: Panels):
    from returnlens.functions.scoring import residual_confidence

    ready = prepared(p)
    totals = assemble.run_totals(ready.windows, plan.market_rows(market_data(p), settings(), ready))
    return totals.select(
        *windows.WINDOW,
        "share_is_stable",
        *[F.round(c, 6).alias(c) for c in ("gross_contribution_leverage", "net_explained_leverage", "residual_leverage")],
        "share_display_status",
        residual_confidence(F.col("unexplained_residual_bps"), F.col("denominator_bps")).alias("safe_confidence"),
    )


@query("shares_of_move", """
SELECT security_id, cadence, window_start, window_end, driver, round(contribution_bps / nullif(observed_return_bps, 0), 6) AS plain_share,
       CASE WHEN abs(observed_return_bps) >= 25 THEN round(contribution_bps / nullif(observed_return_bps, 0), 6) END AS safe_share,
       abs(contribution_bps) <= 100000 AS usable
FROM market_rows""")
def shares_of_move(p: Panels):
    from returnlens.functions.scoring import is_usable_bps, plain_share, safe_share

    rows = plan.market_rows(market_data(p), settings(), prepared(p))
    bps, observed = F.col("contribution_bps"), F.col("observed_return_bps")
    return rows.select(
        *windows.WINDOW,
        "driver",
        F.round(plain_share(bps, observed), 6).alias("plain_share"),
        F.round(safe_share(bps, observed), 6).alias("safe_share"),
        is_usable_bps(bps).alias("usable"),
    )


@query("residual_safety_attribution", """
SELECT security_id, cadence, window_start, window_end,
       CAST(round(CAST(round(residual_bps, 6) AS DECIMAL(24, 6)), 3) AS DOUBLE) AS residual_bps,
       CASE WHEN abs(residual_bps) > 0.5 * greatest(abs(observed_return_bps), 25.0) THEN 'Low' ELSE 'Medium' END AS confidence,
       CASE WHEN abs(observed_return_bps) >= 25 THEN CAST(round(CAST(round(residual_bps / observed_return_bps, 8) AS DECIMAL(24, 8)), 5) AS DOUBLE) END AS share_of_move,
       input_rows + 1 AS contribution_rows
FROM totals_expanded""")
def residual_safety_attribution(p: Panels):
    runs, parts = stored(p, "residual_safety_v1")
    counts = parts.groupBy("attribution_run_id").agg(F.count("*").alias("contribution_rows"))
    rest = with_key(runs, parts).where("driver = 'unexplained_residual'")
    return rest.join(counts, "attribution_run_id").select(
        *windows.WINDOW,
        fixed("contribution_bps", 6, 3).alias("residual_bps"),
        "confidence",
        fixed("share_of_move", 8, 5),
        "contribution_rows",
    )


@query("hierarchical_attribution")
def hierarchical_attribution(p: Panels):
    runs, parts = stored(p, "hierarchical_market_first_v1")
    return with_key(runs, parts).select(
        *windows.WINDOW, "driver", "name", "contribution_bps", "share_of_move", "confidence"
    )


@query("event_evidence", """
SELECT security_id, cadence, window_start, window_end, concat('Event evidence (', category, '/', subtype, ')') AS name,
       event_id, strftime(event_time, '%Y-%m-%d %H:%M:%S') AS event_time FROM event_hits""")
def event_evidence(p: Panels):
    rows = models.event_rows(prepared(p).windows, p.event, p.security, CUTOFF)
    return rows.select(
        *windows.WINDOW,
        "name",
        F.get_json_object("evidence_payload", "$.event_id").cast("long").alias("event_id"),
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"),
    )


@query("contribution_order", """
SELECT security_id, cadence, window_start, window_end, driver, name,
       row_number() OVER (PARTITION BY security_id, cadence, window_start, window_end ORDER BY
         CASE driver WHEN 'market' THEN 0 WHEN 'sector' THEN 1 WHEN 'peer' THEN 2 WHEN 'style' THEN 3 WHEN 'macro' THEN 4
              WHEN 'event' THEN 6 ELSE 99 END, name) AS position FROM part_expanded""")
def contribution_order(p: Panels):
    runs, parts = stored(p)
    ordered = parts.select("attribution_run_id", "driver", "name", "contribution_bps")
    placed = with_key(runs, quality.sorted_positions(ordered, ["attribution_run_id"]))
    return placed.select(*windows.WINDOW, "driver", "name", "position")


@query("reconciliation_check", """
SELECT security_id, cadence, window_start, window_end, CASE security_id % 5 WHEN 0 THEN 'does not reconcile'
       WHEN 1 THEN 'needs exactly one residual row' ELSE 'residual field differs' END AS problem
FROM win WHERE cadence <> 'daily' AND security_id % 5 <= 2""")
def reconciliation_check(p: Panels):
    """Faults of three kinds, planted into the weekly and monthly runs, and found again."""
    runs, parts = stored(p)
    kind = F.when(F.col("cadence") != "daily", F.col("security_id") % 5)
    observed = F.col("observed_return_bps") + F.when(kind == 0, 2.0).otherwise(0.0)
    field = F.col("unexplained_residual_bps") + F.when(kind == 2, 0.5).otherwise(0.0)
    broken = runs.withColumn("observed_return_bps", observed).withColumn("unexplained_residual_bps", field)
    twice = parts.where("driver = 'unexplained_residual'").join(runs.where(kind == 1).select("attribution_run_id"), "attribution_run_id")
    doubled = parts.unionByName(twice.withColumn("contribution_bps", F.lit(0.0)).select(*parts.columns))
    found = quality.reconciliation_breaks(broken, doubled).select("attribution_run_id", "problem")
    return found.join(runs.select("attribution_run_id", *windows.WINDOW), "attribution_run_id").select(*windows.WINDOW, "problem")


@query("lookahead_audit", """
SELECT security_id, cadence, window_start, window_end, 'Unexplained residual' AS name,
       CASE security_id % 3 WHEN 0 THEN '2001-06-01 02:00:00' ELSE '2001-06-01 00:30:00' END AS stated_available
FROM win WHERE security_id % 3 <> 1""")
def lookahead_audit(p: Panels):
    """Availabilities stated in three ways are planted into the residual rows of all runs; two lie after the cutoff."""
    runs, parts = stored(p)
    kinds = runs.select("attribution_run_id", (F.col("security_id") % 3).alias("kind"))
    stated = F.when(F.col("kind") == 0, "2001-06-01T02:00:00Z").when(F.col("kind") == 1, "2001-05-31T23:00:00Z").otherwise("2001-05-31T22:30:00-02:00")
    payload = F.when(F.col("driver") == "unexplained_residual", F.to_json(F.struct(stated.alias("timestamp_available")))).otherwise(F.col("evidence_payload"))
    planted = parts.join(kinds, "attribution_run_id").withColumn("evidence_payload", payload)
    found = quality.lookahead_breaks(runs, planted).select("attribution_run_id", "name", "stated_available")
    return found.join(runs.select("attribution_run_id", *windows.WINDOW), "attribution_run_id").select(
        *windows.WINDOW, "name", F.date_format("stated_available", "yyyy-MM-dd HH:mm:ss").alias("stated_available")
    )


@query("driver_order_audit", """
SELECT security_id, cadence, window_start, window_end, name, 'unknown driver' AS problem FROM part_expanded
WHERE driver = 'sector' AND security_id % 4 = 0
UNION ALL
SELECT p.security_id, p.cadence, p.window_start, p.window_end, p.name, 'systematic row after an event' FROM part_expanded p
WHERE p.driver = 'macro' AND p.security_id % 5 = 2 AND EXISTS (SELECT 1 FROM part_expanded e WHERE e.security_id = p.security_id
  AND e.cadence = p.cadence AND e.window_start = p.window_start AND e.window_end = p.window_end AND e.driver = 'event')""")
def driver_order_audit(p: Panels):
    """Two faults planted into all runs: sector rows under an unknown driver, and macro rows moved behind the events."""
    runs, parts = stored(p)
    keyed = with_key(runs, parts)
    strange = (F.col("driver") == "sector") & (F.col("security_id") % 4 == 0)
    unknown = quality.driver_order_breaks(keyed.withColumn("driver", F.when(strange, "hearsay").otherwise(F.col("driver"))))
    moved = F.when((F.col("driver") == "macro") & (F.col("security_id") % 5 == 2), 1000).otherwise(0)
    placed = quality.sorted_positions(keyed, ["attribution_run_id"]).withColumn("position", F.col("position") + moved)
    late = quality.systematic_order_breaks(placed, ["attribution_run_id"])
    shown = lambda found, problem: found.select(*windows.WINDOW, "name", F.lit(problem).alias("problem"))
    return shown(unknown, "unknown driver").unionByName(shown(late, "systematic row after an event"))


@query("pit_columns_audit", """
SELECT 'price_raw' AS table_name, 'event_time' AS missing_column, count(*) AS rows FROM price_raw
UNION ALL SELECT 'macro_series', 'event_time', count(*) FROM macro_series UNION ALL SELECT 'macro_series', 'ingestion_time', count(*) FROM macro_series
UNION ALL SELECT 'factor_return', 'event_time', count(*) FROM factor_return UNION ALL SELECT 'factor_return', 'ingestion_time', count(*) FROM factor_return""")
def pit_columns_audit(p: Panels):
    """Point-in-time columns that a table lacks, with how many rows that concerns."""
    tables = {name: getattr(p, name) for name in ("price_raw", "macro_series", "factor_return", "event")}
    rows = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), F.lit(column).alias("missing_column"), "rows")
        for name, df in tables.items()
        for column in quality.missing_pit_columns(df)
    ]
    return reduce(DataFrame.unionByName, rows)


# ---- oracle side: what every window reads, kind by kind, by literal ranges
_seen = """
SELECT {columns}, timestamp_available AS available FROM (SELECT *, row_number() OVER (PARTITION BY {key}, event_date
  ORDER BY timestamp_available DESC, source{more}) AS rn FROM {table} WHERE timestamp_available <= {at}) r WHERE rn = 1"""
STEPS["fac_seen"] = _seen.format(columns="factor_name, event_date", key="factor_name", more="", table="factor_return", at=AT)
STEPS["mac_seen"] = _seen.format(columns="series_name, event_date", key="series_name", more=", vintage NULLS LAST", table="macro_series", at=AT)
STEPS["spans"] = "SELECT DISTINCT window_start, window_end FROM win"
STEPS["fac_newest"] = f"""
SELECT s.window_start, s.window_end, f.factor_name, max(f.available) AS available FROM spans s
JOIN fac_seen f ON f.event_date >= s.window_start - {LOOKBACK} AND f.event_date <= s.window_end GROUP BY ALL"""
STEPS["mac_newest"] = f"""
SELECT s.window_start, s.window_end, f.series_name, max(f.available) AS available FROM spans s
JOIN mac_seen f ON f.event_date >= s.window_start - {LOOKBACK} AND f.event_date <= s.window_end GROUP BY ALL"""
STEPS["factor_keys"] = """
SELECT security_id, unnest(['Mkt-RF', 'SMB', 'HML', 'RMW', 'CMA']) AS factor_name FROM security
UNION ALL SELECT security_id, concat('sector:', sector) FROM classes
UNION ALL SELECT security_id, concat('industry:', industry) FROM classes WHERE industry IS NOT NULL AND industry <> ''"""
STEPS["macro_keys"] = """
SELECT DISTINCT g.security_id, m.series_name FROM gates g JOIN (VALUES ('macro:2y_yield_change', 'DGS2'), ('macro:10y_yield_change', 'DGS10'),
  ('macro:hy_spread_change', 'BAMLH0A0HYM2'), ('macro:ig_spread_change', 'BAMLC0A0CM'), ('macro:vix_return', 'VIXCLS'),
  ('macro:inflation_expectation_change', 'T5YIE'), ('macro:2s10s_curve_change', 'DGS10'), ('macro:2s10s_curve_change', 'DGS2')) m(series_key, series_name)
  ON m.series_key = g.series_key WHERE g.gate > 0"""
STEPS["ret_seen"] = """
SELECT security_id, event_date, greatest(timestamp_available, earlier) AS available FROM (
  SELECT security_id, event_date, timestamp_available, lag(timestamp_available) OVER (PARTITION BY security_id ORDER BY event_date) AS earlier FROM bars) b
WHERE earlier IS NOT NULL"""
STEPS["ranged_inputs"] = f"""
SELECT w.security_id, w.cadence, w.window_start, w.window_end, 'bar' AS kind, max(b.timestamp_available) AS available
FROM win w JOIN bars b ON b.security_id = w.security_id AND b.event_date >= w.window_start - {LOOKBACK} AND b.event_date <= w.window_end GROUP BY ALL
UNION ALL
SELECT w.security_id, w.cadence, w.window_start, w.window_end, 'factor', max(n.available) FROM win w JOIN factor_keys k ON k.security_id = w.security_id
JOIN fac_newest n ON n.factor_name = k.factor_name AND n.window_start = w.window_start AND n.window_end = w.window_end GROUP BY ALL
UNION ALL
SELECT w.security_id, w.cadence, w.window_start, w.window_end, 'macro', max(n.available) FROM win w JOIN macro_keys k ON k.security_id = w.security_id
JOIN mac_newest n ON n.series_name = k.series_name AND n.window_start = w.window_start AND n.window_end = w.window_end GROUP BY ALL
UNION ALL
SELECT w.security_id, w.cadence, w.window_start, w.window_end, 'peer', max(r.available) FROM win w JOIN weights t ON t.target_security_id = w.security_id
JOIN ret_seen r ON r.security_id = t.peer_security_id AND r.event_date >= w.window_start - {LOOKBACK} AND r.event_date <= w.window_end GROUP BY ALL
UNION ALL
SELECT w.security_id, w.cadence, w.window_start, w.window_end, 'event', max(e.timestamp_available) FROM win w JOIN security s ON s.security_id = w.security_id
JOIN event e ON e.company_id = s.company_id AND CAST(e.event_time AS DATE) >= w.window_start AND CAST(e.event_time AS DATE) <= w.window_end
WHERE e.timestamp_available <= {AT} GROUP BY ALL"""
STEPS["held_inputs"] = f"""
SELECT security_id, 'classification' AS kind, timestamp_available AS available FROM (
  SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY event_date DESC) AS rn FROM classification WHERE timestamp_available <= {AT}) c WHERE rn = 1
UNION ALL
SELECT target_security_id, 'basket', max(available) FROM (
  SELECT target_security_id, timestamp_available AS available FROM peer_basket WHERE timestamp_available <= {AT}
  UNION ALL SELECT m.target_security_id, p.timestamp_available FROM seen_members m JOIN peer_member p ON p.peer_security_id = m.peer_security_id
    AND p.peer_basket_id = m.target_security_id) b GROUP BY ALL
UNION ALL
SELECT s.security_id, 'exposure', max(e.timestamp_available) FROM company_exposure e JOIN security s ON s.company_id = e.company_id
WHERE e.timestamp_available <= {AT} GROUP BY ALL"""
STEPS["newest_inputs"] = """
SELECT security_id, cadence, window_start, window_end, kind, available FROM ranged_inputs
UNION ALL SELECT w.security_id, w.cadence, w.window_start, w.window_end, h.kind, h.available FROM win w JOIN held_inputs h ON h.security_id = w.security_id"""
LATE_FACTOR = "factor_name = 'SMB' AND event_date >= DATE '1997-03-03' AND event_date <= DATE '1997-03-07'"


@query("input_availability_audit", f"""
SELECT security_id, cadence, window_start, window_end, kind, strftime(available, '%Y-%m-%d %H:%M:%S') AS inputs_available, available > {AT} AS late
FROM newest_inputs""", steps={"fac_seen": f"""
SELECT factor_name, event_date, CASE WHEN {LATE_FACTOR} THEN TIMESTAMP '2002-01-01 00:00:00' ELSE available END AS available
FROM ({STEPS["fac_seen"]}) f"""})
def input_availability_audit(p: Panels):
    """Newest availability of every kind of input of every window, with a week of one factor planted after the cutoff."""
    inputs = availability.used_inputs(market_data(p), settings())
    planted = (F.col("kind") == "factor") & (F.col("key") == "SMB") & F.col("event_date").between(F.lit("1997-03-03").cast("date"), F.lit("1997-03-07").cast("date"))
    late = F.when(planted, F.lit("2002-01-01 00:00:00").cast("timestamp_ntz")).otherwise(F.col("value"))
    seen = availability.newest(prepared(p).windows, replace(inputs, facts=inputs.facts.withColumn("value", late)))
    return seen.select(
        *windows.WINDOW, "kind", F.date_format("inputs_available", "yyyy-MM-dd HH:mm:ss").alias("inputs_available"),
        (F.col("inputs_available") > F.lit(CUTOFF).cast("timestamp_ntz")).alias("late"),
    )


#: Cutoff of the runs that are stored before bars are restated.
SINCE = "2001-05-20 00:00:00"
RESTATED = "security_id % 8 = 3 AND event_date >= DATE '1997-03-03' AND event_date <= DATE '1997-03-14'"
_restated_bars = {"price_raw": f"""{PANELS["price_raw"].format(**DUCK_NAMES)}
UNION ALL
SELECT security_id, event_date, adjusted_close * 1.02, adjusted_close * 1.02, volume, 'USD', 'c', TIMESTAMP '2001-05-25 00:00:00', TIMESTAMP '2001-05-25 00:00:00'
FROM first_prints WHERE {RESTATED}"""}


def restated(p: Panels) -> plan.MarketData:
    """Two weeks of bars of some securities restated, available between the stored runs' cutoff and the present one."""
    late = F.lit("2001-05-25 00:00:00").cast("timestamp_ntz")
    first = p.price_raw.where((F.col("source") == "a") & F.expr(RESTATED))
    again = first.withColumns({
        "close": F.col("adjusted_close") * 1.02, "adjusted_close": F.col("adjusted_close") * 1.02, "source": F.lit("c"),
        "ingestion_time": late, "timestamp_available": late,
    })
    return replace(market_data(p), bars=p.price_raw.unionByName(again))


def stored_before(p: Panels) -> DataFrame:
    """The windows that runs at the earlier cutoff hold, as a store lists them."""
    before = replace(settings(), cutoff=SINCE)
    model, basket = METHODOLOGIES["legacy"]
    built = plan.select_windows(pit.visible_bars(p.price_raw, SINCE), before)
    return built.select(*windows.WINDOW, F.lit(model).alias("model_version"), F.lit(basket).alias("factor_basket_version"))


TOUCHED_SQL = f"SELECT DISTINCT security_id, cadence, window_start, window_end FROM newest_inputs WHERE available > TIMESTAMP '{SINCE}'"


@query("touched_windows", TOUCHED_SQL, steps=_restated_bars)
def touched_windows(p: Panels):
    """Windows to attribute again: with restated bars of their own or of a peer, or with anything newer than the stored runs."""
    return availability.touched_windows(restated(p), settings(), stored_before(p), SINCE).select(*windows.WINDOW)


@query("refreshed_attribution", f"""
SELECT r.security_id, r.cadence, r.window_start, r.window_end, r.driver, r.name,
       CAST(round(CAST(r.contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps, count(*) AS copies
FROM part_expanded r JOIN ({TOUCHED_SQL}) t ON t.security_id = r.security_id AND t.cadence = r.cadence AND t.window_start = r.window_start
 AND t.window_end = r.window_end GROUP BY ALL""", steps=_restated_bars)
def refreshed_attribution(p: Panels):
    """The touched windows attributed again on the restated data, and no others."""
    return copies(*availability.refresh(restated(p), settings(), stored_before(p), SINCE))


@query("upsert_prices", """
SELECT security_id, event_date, source, round(close, 6) AS close FROM (
  SELECT *, row_number() OVER (PARTITION BY security_id, event_date, source ORDER BY fresh DESC) AS rn FROM (
    SELECT security_id, event_date, source, close, 0 AS fresh FROM price_raw WHERE event_date < DATE '1999-01-01'
    UNION ALL SELECT security_id, event_date, source, close * 2, 1 FROM price_raw WHERE event_date >= DATE '1998-06-01') u) r
WHERE rn = 1""")
def upsert_prices(p: Panels):
    old = p.price_raw.where("event_date < DATE '1999-01-01'")
    new = p.price_raw.where("event_date >= DATE '1998-06-01'").withColumn("close", F.col("close") * 2)
    merged = upsert.upsert(
        old, new, ["security_id", "event_date", "source"], [F.col("timestamp_available").desc()]
    )
    return merged.select("security_id", "event_date", "source", F.round("close", 6).alias("close"))


@query("insert_absent_tickers", """
SELECT ticker, security_id FROM ticker_history WHERE security_id % 2 = 0
UNION ALL SELECT ticker, security_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY active_from DESC, security_id) AS rn
  FROM ticker_history WHERE security_id % 3 <> 0) t
WHERE rn = 1 AND ticker NOT IN (SELECT ticker FROM ticker_history WHERE security_id % 2 = 0)""")
def insert_absent_tickers(p: Panels):
    old = p.ticker_history.where("security_id % 2 = 0")
    new = p.ticker_history.where("security_id % 3 <> 0")
    merged = upsert.insert_absent(old, new, ["ticker"], [F.col("active_from").desc(), F.col("security_id").asc()])
    return merged.select("ticker", "security_id")


@query("store_attribution_results", """
SELECT security_id, cadence, window_start, window_end, driver, name, CAST(round(CAST(contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps,
       count(*) AS copies FROM part_expanded GROUP BY ALL""")
def store_attribution_results(p: Panels):
    """Writing the same results over themselves leaves one copy of every run and contribution."""
    runs, parts = stored(p)
    again = runs.where("security_id % 2 = 0")
    kept_runs, kept_parts = upsert.store_results(
        runs, parts, again, parts.join(again.select("attribution_run_id"), "attribution_run_id", "left_semi")
    )
    return copies(kept_runs, kept_parts)


@query("resume_backfill", """
SELECT security_id, cadence, window_start, window_end, driver, name, CAST(round(CAST(contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps,
       count(*) AS copies FROM part_expanded WHERE security_id % 2 = 1 GROUP BY ALL""")
def resume_backfill(p: Panels):
    """The windows a half-filled store does not hold, attributed."""
    runs, _ = stored(p)
    return copies(*plan.resume(market_data(p), settings(), runs.where("security_id % 2 = 0")))


@query("daily_batch_attribution", """
SELECT security_id, cadence, window_start, window_end, driver, name, CAST(round(CAST(contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps,
       count(*) AS copies FROM part_expanded
WHERE cadence = 'daily' AND window_start = DATE '1998-03-10' AND window_end = DATE '1998-03-11' GROUP BY ALL""")
def daily_batch_attribution(p: Panels):
    return copies(*backfill.daily_batch(market_data(p), settings(), "1998-03-10", "1998-03-11"))


@query("latest_daily_attribution", """
SELECT security_id, cadence, window_start, window_end, driver, name, CAST(round(CAST(contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps,
       count(*) AS copies FROM part_expanded
WHERE cadence = 'daily' AND (security_id, window_end) IN (SELECT (security_id, max(event_date)) FROM bars WHERE event_date <= DATE '1999-06-20' GROUP BY security_id)
GROUP BY ALL""")
def latest_daily_attribution(p: Panels):
    return copies(*backfill.latest_daily(market_data(p), settings(), "1999-06-20"))


@query("pilot_attribution", """
SELECT security_id, cadence, window_start, window_end, driver, name, CAST(round(CAST(contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps,
       count(*) AS copies FROM part_expanded
WHERE cadence = 'monthly' AND security_id % 2 = 1 AND driver <> 'event' AND (security_id, window_start) IN (
  SELECT (security_id, window_start) FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY window_start) AS rn FROM all_windows
    WHERE cadence = 'monthly' AND window_start >= DATE '1998-01-01' AND window_end <= DATE '2000-12-31') w WHERE rn <= 18) GROUP BY ALL""")
def pilot_attribution(p: Panels):
    """The first eighteen windows of a span under another methodology; half of the securities are stored already."""
    kept = replace(settings(methodology="residual_safety_v1"), cadences=["monthly"], include_events=False)
    runs, _ = stored(p, "residual_safety_v1")
    return copies(*backfill.pilot(market_data(p), kept, "1998-01-01", "2000-12-31", 18, runs.where("security_id % 2 = 0")))


METRICS_SQL = """
SELECT 'factor-baseline-v0' AS model_version, count(*) AS runs, count(*) FILTER (WHERE abs(observed_return_bps) >= 25) AS stable_runs,
       round(avg(abs(unexplained_residual_bps)), 4) AS residual_mae_bps,
       round(sqrt(avg(unexplained_residual_bps * unexplained_residual_bps)), 4) AS residual_rmse_bps,
       round(sum(abs(unexplained_residual_bps)) FILTER (WHERE abs(observed_return_bps) >= 25)
             / sum(abs(observed_return_bps)) FILTER (WHERE abs(observed_return_bps) >= 25), 6) AS weighted_abs_residual_share,
       round(list_sort(list(gross_bps / greatest(abs(observed_return_bps), 25.0)))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1], 4) AS gross_leverage_p95,
       round(list_sort(list(abs(unexplained_residual_bps) / greatest(abs(observed_return_bps), 25.0)))[CAST(round_even((count(*) - 1) * 0.95, 0) AS BIGINT) + 1], 4) AS residual_leverage_p95
FROM run_expanded"""


def shown_metrics(m):
    four = ["residual_mae_bps", "residual_rmse_bps", "gross_leverage_p95", "residual_leverage_p95"]
    return m.select(
        "model_version",
        "runs",
        "stable_runs",
        *[F.round(c, 4).alias(c) for c in four],
        F.round("weighted_abs_residual_share", 6).alias("weighted_abs_residual_share"),
    )


@query("methodology_metrics", METRICS_SQL)
def methodology_metrics(p: Panels):
    return shown_metrics(reports.methodology_metrics(*stored(p)))


def members(p: Panels):
    return p.security.withColumnRenamed("legal_name", "company_name").drop("sector", "industry")


@query("run_narratives", """
SELECT t.security_id, t.cadence, t.window_start, t.window_end, concat(
  'Observed move was ', format('{:.1f}', observed_return_bps), ' bps over the selected window. ',
  CASE WHEN top IS NULL THEN 'No production factor rows were available, so the move remains residual-driven.'
       ELSE concat('Largest modeled drivers were ', top, '.') END,
  CASE WHEN abs(observed_return_bps) >= 25 THEN concat(' Unexplained residual was ', format('{:.1f}', unexplained_residual_bps),
         ' bps, which is ', CASE WHEN abs(unexplained_residual_bps) / abs(observed_return_bps) > 0.5 THEN 'large' ELSE 'contained' END,
         ' relative to the move.')
       ELSE concat(' Unexplained residual was ', format('{:.1f}', unexplained_residual_bps),
         ' bps; share percentages are unstable for this small observed move.') END,
  CASE WHEN events > 0 THEN concat(' ', events, ' visible event evidence row(s) were attached but not assigned causal contribution.')
       ELSE '' END) AS narrative
FROM run_expanded t LEFT JOIN (
  SELECT security_id, cadence, window_start, window_end,
         string_agg(concat(name, ' (', format('{:.1f}', contribution_bps), ' bps)'), ', ' ORDER BY rn) AS top
  FROM (SELECT *, row_number() OVER (PARTITION BY security_id, cadence, window_start, window_end
          ORDER BY abs(contribution_bps) DESC, CASE driver WHEN 'market' THEN 0 WHEN 'sector' THEN 1 WHEN 'peer' THEN 2
            WHEN 'style' THEN 3 WHEN 'macro' THEN 4 ELSE 6 END, name) AS rn
        FROM part_expanded WHERE driver <> 'unexplained_residual' AND abs(contribution_bps) > 0) x
  WHERE rn <= 3 GROUP BY ALL) n
ON n.security_id = t.security_id AND n.cadence = t.cadence AND n.window_start = t.window_start AND n.window_end = t.window_end""")
def run_narratives(p: Panels):
    runs, parts = stored(p)
    return assemble.narratives(runs, parts).select(*windows.WINDOW, "narrative")


@query("run_details", """
SELECT security_id, cadence, window_start, window_end, driver, name, CAST(round(CAST(round(contribution_bps, 6) AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps,
       CASE WHEN abs(round(observed_return_bps, 6)) >= 25 THEN CAST(round(CAST(round(contribution_bps / observed_return_bps, 8) AS DECIMAL(24, 8)), 5) AS DOUBLE) END AS share_of_move
FROM (SELECT security_id, cadence, window_start, window_end, observed_return_bps, driver, name, contribution_bps FROM expanded_rows
      UNION ALL SELECT security_id, cadence, window_start, window_end, observed_return_bps, 'unexplained_residual', 'Unexplained residual', residual_bps
      FROM totals_expanded) c""")
def run_details(p: Panels):
    return reports.run_details(*stored(p)).select(
        *windows.WINDOW,
        "driver",
        "name",
        fixed("contribution_bps", 6, 3),
        fixed("share_of_move", 8, 5),
    )


@query("run_history", """
SELECT security_id, window_start, window_end, round(observed_return_bps, 4) AS observed_return_bps FROM run_market
WHERE cadence = 'daily' AND security_id = 3 ORDER BY window_end DESC LIMIT 300""")
def run_history(p: Panels):
    runs, _ = stored(p, expanded=False)
    return reports.run_history(runs.where("security_id = 3"), 300, "daily").select(
        "security_id", "window_start", "window_end", F.round("observed_return_bps", 4).alias("observed_return_bps")
    )


@query("latest_runs", """
SELECT security_id, max(window_end) AS window_end FROM win WHERE cadence = 'daily' GROUP BY security_id""")
def latest_runs(p: Panels):
    return universe.latest_runs(stored(p, expanded=False)[0]).select("security_id", "window_end")


STEPS["summary_rows"] = """
SELECT s.security_id, s.ticker, s.legal_name AS company_name, s.exchange, k.sector, k.industry, r.window_end AS latest_window_end,
       r.observed_return_bps AS latest_observed_return_bps, r.unexplained_residual_bps AS latest_residual_bps,
       e.adjusted_close - b.adjusted_close AS latest_price_change_usd, t.name AS top_driver,
       coalesce(n.contribution_count, 0) AS contribution_count, coalesce(n.evidence_count, 0) AS evidence_count,
       CASE WHEN r.security_id IS NULL THEN 'missing' ELSE 'available' END AS run_status
FROM security s
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY window_end DESC) AS rn
           FROM run_expanded WHERE cadence = 'daily') x WHERE rn = 1) r ON r.security_id = s.security_id
LEFT JOIN bars b ON b.security_id = r.security_id AND b.event_date = r.window_start
LEFT JOIN bars e ON e.security_id = r.security_id AND e.event_date = r.window_end
LEFT JOIN (SELECT security_id, window_start, window_end, count(*) AS contribution_count,
                  count(*) FILTER (WHERE driver <> 'unexplained_residual') AS evidence_count FROM part_expanded WHERE cadence = 'daily'
           GROUP BY ALL) n ON n.security_id = r.security_id AND n.window_start = r.window_start AND n.window_end = r.window_end
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id, window_start, window_end ORDER BY abs(contribution_bps) DESC,
             CASE driver WHEN 'market' THEN 0 WHEN 'sector' THEN 1 WHEN 'peer' THEN 2 WHEN 'style' THEN 3 WHEN 'macro' THEN 4 ELSE 6 END, name) AS rn
           FROM part_expanded WHERE cadence = 'daily' AND driver <> 'unexplained_residual') z WHERE rn = 1) t
  ON t.security_id = r.security_id AND t.window_start = r.window_start AND t.window_end = r.window_end
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY security_id ORDER BY timestamp_available DESC, event_date DESC) AS rn
           FROM classification) y WHERE rn = 1) k ON k.security_id = s.security_id"""


def summary_rows(p: Panels):
    runs, parts = stored(p)
    return universe.summaries(members(p), runs, parts, p.classification, p.price_raw, CUTOFF)


SUMMARIES_SQL = """
SELECT security_id, ticker, sector, industry, latest_window_end, round(latest_observed_return_bps, 4) AS latest_observed_return_bps,
       round(latest_residual_bps, 4) AS latest_residual_bps, round(latest_price_change_usd, 6) AS latest_price_change_usd,
       top_driver, contribution_count, evidence_count, run_status FROM summary_rows"""


def shown_summaries(rows: DataFrame) -> DataFrame:
    return rows.select(
        "security_id",
        "ticker",
        "sector",
        "industry",
        "latest_window_end",
        F.round("latest_observed_return_bps", 4).alias("latest_observed_return_bps"),
        F.round("latest_residual_bps", 4).alias("latest_residual_bps"),
        F.round("latest_price_change_usd", 6).alias("latest_price_change_usd"),
        "top_driver",
        "contribution_count",
        "evidence_count",
        "run_status",
    )


@query("security_summaries", SUMMARIES_SQL)
def security_summaries(p: Panels):
    return shown_summaries(summary_rows(p))


@query("refreshed_summaries", SUMMARIES_SQL)
def refreshed_summaries(p: Panels):
    """Summaries of the runs up to a day, or up to none for some securities, brought up to date by the runs since."""
    runs, parts = stored(p)
    since = (F.col("window_end") >= F.lit("1998-06-01").cast("date")) & (F.col("security_id") % 3 != 1) | (F.col("security_id") % 7 == 2)
    before, delta = runs.where(~since), runs.where(since)
    # Contributions are read by the id of a run on either side, so both sides are given all of them.
    kept = settle(universe.summaries(members(p).where("security_id <> 5"), before, parts, p.classification, p.price_raw, CUTOFF), "summaries")
    return shown_summaries(universe.refreshed_summaries(kept, members(p), delta, parts, p.classification, p.price_raw, CUTOFF))


@query("universe_page", """
SELECT ticker, company_name, round(latest_observed_return_bps, 4) AS latest_observed_return_bps,
       CASE WHEN abs(latest_observed_return_bps) >= 25
            THEN round(latest_residual_bps / latest_observed_return_bps * latest_price_change_usd, 4) END AS latest_residual_usd,
       evidence_count > 0 AS has_evidence
FROM summary_rows ORDER BY latest_observed_return_bps DESC NULLS LAST, ticker LIMIT 10 OFFSET 5""")
def universe_page(p: Panels):
    page = universe.universe_page(summary_rows(p), "move", descending=True, limit=10, offset=5)
    return page.select(
        "ticker",
        "company_name",
        F.round("latest_observed_return_bps", 4).alias("latest_observed_return_bps"),
        F.round("latest_residual_usd", 4).alias("latest_residual_usd"),
        "has_evidence",
    )


@query("universe_total", "SELECT count(*) AS total FROM summary_rows WHERE run_status = 'available' AND upper(exchange) = 'NASDAQ'")
def universe_total(p: Panels):
    return universe.page_total(universe.filter_universe(summary_rows(p), exchange="nasdaq", status="available"))


@query("universe_filter", """
SELECT ticker, sector, exchange FROM summary_rows
WHERE (upper(ticker) LIKE '%ION_1%' OR upper(company_name) LIKE '%ION_1%') AND upper(exchange) = 'NASDAQ' AND run_status = 'available'""")
def universe_filter(p: Panels):
    found = universe.filter_universe(summary_rows(p), search="ion_1", exchange="nasdaq", status="available")
    return found.select("ticker", "sector", "exchange")


@query("universe_options", """
SELECT DISTINCT kind, value, label FROM (
  SELECT 'sector' AS kind, sector AS value, CAST(NULL AS VARCHAR) AS label FROM summary_rows
  UNION ALL SELECT 'industry', industry, NULL FROM summary_rows
  UNION ALL SELECT 'exchange', exchange, NULL FROM summary_rows
  UNION ALL SELECT 'company', ticker, company_name FROM summary_rows) o WHERE value IS NOT NULL AND value <> ''""")
def universe_options(p: Panels):
    return universe.universe_options(summary_rows(p))


@query("universe_status_counts", "SELECT run_status, count(*) AS securities FROM summary_rows GROUP BY run_status")
def universe_status_counts(p: Panels):
    return summary_rows(p).groupBy("run_status").agg(F.count("*").alias("securities"))


@query("universe_ticker_dedupe", """
SELECT ticker, security_id FROM (
  SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY (latest_run_id IS NOT NULL) DESC, latest_window_end DESC NULLS LAST,
    (coalesce(sector, '') <> '') DESC, (coalesce(industry, '') <> '') DESC, security_id) AS rn FROM (
    SELECT concat('T', security_id % 7) AS ticker, security_id, CASE WHEN security_id % 4 = 0 THEN NULL ELSE 'r' END AS latest_run_id,
           CASE WHEN security_id % 3 = 0 THEN NULL ELSE latest_window_end END AS latest_window_end, sector, industry
    FROM summary_rows) s) x WHERE rn = 1""")
def universe_ticker_dedupe(p: Panels):
    rows = summary_rows(p).select(
        F.concat(F.lit("T"), (F.col("security_id") % 7).cast("string")).alias("ticker"),
        "security_id",
        F.when(F.col("security_id") % 4 != 0, "r").alias("latest_run_id"),
        F.when(F.col("security_id") % 3 != 0, F.col("latest_window_end")).alias("latest_window_end"),
        "sector",
        "industry",
    )
    return universe.dedupe_by_ticker(rows).select("ticker", "security_id")


STEPS["chart_bars"] = """
SELECT security_id, event_date, adjusted_close FROM (
  SELECT p.*, row_number() OVER (PARTITION BY p.security_id, p.event_date ORDER BY p.timestamp_available DESC, p.source) AS rn
  FROM price_raw p JOIN (SELECT security_id, max(event_date) AS chart_end FROM price_raw GROUP BY 1) m
    ON m.security_id = p.security_id AND p.event_date >= m.chart_end - 366) x WHERE rn = 1"""

STEPS["chart_path"] = """
SELECT security_id, event_date, adjusted_close,
       (adjusted_close / first_value(adjusted_close) OVER (PARTITION BY security_id ORDER BY event_date) - 1) * 100 AS cumulative_return_pct
FROM chart_bars"""

STEPS["chart_rows"] = """
SELECT c.security_id, c.window_end AS event_date, c.driver, c.name, c.contribution_bps / 100 AS contribution_pct,
       CASE WHEN abs(r.observed_return_bps) >= 25 THEN c.share_of_move END AS share_of_move
FROM part_expanded c JOIN run_expanded r ON r.security_id = c.security_id AND r.cadence = c.cadence
 AND r.window_start = c.window_start AND r.window_end = c.window_end
JOIN (SELECT security_id, max(event_date) AS chart_end FROM price_raw GROUP BY 1) m ON m.security_id = c.security_id
WHERE c.cadence = 'weekly' AND c.window_end BETWEEN m.chart_end - 366 AND m.chart_end"""


def chart(p: Panels):
    runs, parts = stored(p)
    bounds = reports.chart_bounds(p.price_raw, "1y")
    return reports.chart_prices(p.price_raw, bounds), reports.chart_points(runs, parts, bounds, "1y")


@query("chart_prices", """
SELECT security_id, event_date, round(cumulative_return_pct, 6) AS cumulative_return_pct FROM chart_path""")
def chart_prices(p: Panels):
    return chart(p)[0].select(
        "security_id", "event_date", F.round("cumulative_return_pct", 6).alias("cumulative_return_pct")
    )


@query("chart_points", """
SELECT security_id, event_date, driver, name, CAST(round(CAST(contribution_pct AS DECIMAL(24, 8)), 4) AS DOUBLE) AS contribution_pct,
       CAST(round(CAST(share_of_move AS DECIMAL(24, 8)), 5) AS DOUBLE) AS share_of_move FROM chart_rows""")
def chart_points(p: Panels):
    return chart(p)[1].select(
        "security_id",
        "event_date",
        "driver",
        "name",
        fixed("contribution_pct", 8, 4),
        fixed("share_of_move", 8, 5),
    )


@query("chart_driver_order", """
SELECT security_id, driver, row_number() OVER (PARTITION BY security_id ORDER BY CASE driver WHEN 'market' THEN 1 WHEN 'sector' THEN 2 WHEN 'peer' THEN 4 WHEN 'style' THEN 5 WHEN 'macro' THEN 6 WHEN 'event' THEN 8 ELSE 9 END) AS position
FROM (SELECT DISTINCT security_id, driver FROM chart_rows) d""")
def chart_driver_order(p: Panels):
    return reports.driver_order(chart(p)[1], ["security_id"]).select("security_id", "driver", "position")


@query("chart_period_sums", """
SELECT security_id, event_date, driver, CAST(round(CAST(sum(contribution_pct) AS DECIMAL(24, 8)), 4) AS DOUBLE) AS period_pct FROM chart_rows GROUP BY ALL""")
def chart_period_sums(p: Panels):
    return reports.period_sums(chart(p)[1]).select(
        "security_id", "event_date", "driver", fixed("period_pct", 8, 4)
    )


def _cell(value: str) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(24, 8)), 4) AS DOUBLE)"


@query("chart_bands", f"""
SELECT security_id, event_date, driver, {_cell('net_pct')} AS net_pct, {_cell('pos_to - up')} AS positive_from, {_cell('pos_to')} AS positive_to,
       {_cell('neg_to')} AS negative_from, {_cell('neg_to - down')} AS negative_to,
       CASE WHEN abs(border) > 0.000001 THEN {_cell('border')} END AS opposite_border_pct
FROM (SELECT *, sum(up) OVER w AS pos_to, sum(down) OVER w AS neg_to,
        CASE WHEN cumulative_return_pct >= 0 THEN sum(down) OVER d ELSE sum(up) OVER d END AS border
      FROM (SELECT *, CASE WHEN net_pct > 0.000001 THEN net_pct ELSE 0.0 END AS up,
                   CASE WHEN net_pct < -0.000001 THEN net_pct ELSE 0.0 END AS down
            FROM (SELECT c.security_id, c.event_date, c.cumulative_return_pct, o.driver,
                    sum(coalesce(s.period_pct, 0.0)) OVER (PARTITION BY c.security_id, o.driver ORDER BY c.event_date) AS net_pct
                  FROM chart_path c JOIN (SELECT DISTINCT security_id, driver FROM chart_rows) o ON o.security_id = c.security_id
                  LEFT JOIN (SELECT security_id, event_date, driver, sum(contribution_pct) AS period_pct FROM chart_rows GROUP BY ALL) s
                    ON s.security_id = c.security_id AND s.event_date = c.event_date AND s.driver = o.driver) n) u
      WINDOW w AS (PARTITION BY security_id, event_date ORDER BY CASE driver WHEN 'market' THEN 1 WHEN 'sector' THEN 2 WHEN 'peer' THEN 4 WHEN 'style' THEN 5 WHEN 'macro' THEN 6 WHEN 'event' THEN 8 ELSE 9 END),
             d AS (PARTITION BY security_id, event_date)) b""")
def chart_bands(p: Panels):
    prices, points = chart(p)
    bands = reports.stacked_bands(points, prices)
    values = ["net_pct", "positive_from", "positive_to", "negative_from", "negative_to", "opposite_border_pct"]
    return bands.select("security_id", "event_date", "driver", *[fixed(v, 8, 4) for v in values])


@query("average_shares", """
SELECT driver, name, round(avg(share_of_move), 5) AS average_share_of_move FROM chart_rows WHERE share_of_move IS NOT NULL
GROUP BY driver, name""")
def average_shares(p: Panels):
    mean = reports.average_shares(chart(p)[1], [])
    return mean.select("driver", "name", F.round("average_share_of_move", 5).alias("average_share_of_move"))


@query("chart_selection", """
SELECT security_id, min(event_date) AS selected_from, max(event_date) AS selected_to,
       round((arg_max(adjusted_close, event_date) / arg_min(adjusted_close, event_date) - 1) * 100, 6) AS price_change_pct
FROM chart_path WHERE event_date BETWEEN DATE '2001-02-01' AND DATE '2001-04-15' GROUP BY security_id HAVING count(*) >= 2""")
def chart_selection(p: Panels):
    chosen = reports.selection_summary(chart(p)[0], "2001-04-15", "2001-02-01")
    return chosen.select("security_id", "selected_from", "selected_to", F.round("price_change_pct", 6).alias("price_change_pct"))


@query("driver_table", """
SELECT driver, name, CAST(round(CAST(contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps, count(*) AS rows FROM part_expanded
WHERE driver = 'market' GROUP BY ALL""")
def driver_table(p: Panels):
    rows = reports.driver_table(stored(p)[1], "market")
    return rows.groupBy("driver", "name", fixed("contribution_bps", 6, 3)).agg(
        F.count("*").alias("rows")
    )


@query("driver_export", """
SELECT c.security_id, c.cadence, c.window_start, c.window_end, c.driver, c.name,
       CAST(round(CAST(c.contribution_bps AS DECIMAL(24, 6)), 3) AS DOUBLE) AS contribution_bps,
       CASE WHEN abs(r.observed_return_bps) >= 25 THEN CAST(round(CAST(c.share_of_move AS DECIMAL(24, 8)), 5) AS DOUBLE) END AS share_of_move,
       count(*) AS copies
FROM part_expanded c JOIN run_expanded r ON r.security_id = c.security_id AND r.cadence = c.cadence AND r.window_start = c.window_start
 AND r.window_end = c.window_end GROUP BY ALL""")
def driver_export(p: Panels):
    """The export written as quoted CSV and read back, cell by cell."""
    from returnlens.session import scratch_path

    runs, parts = stored(p)
    path = scratch_path(p.spark, "export")
    reports.write_export(reports.export_rows(runs, parts), path, compression="gzip")
    back = p.spark.read.option("header", True).option("escape", '"').schema(
        "attribution_run_id string, driver string, name string, contribution_bps string, share_of_move string, "
        "confidence string, stage string, evidence string, evidence_payload string"
    ).csv(path)
    cells = back.withColumn("contribution_bps", F.col("contribution_bps").cast("double")).withColumn(
        "share_of_move", F.nullif("share_of_move", F.lit("")).cast("double")
    )
    shown = with_key(runs, cells).select(*windows.WINDOW, "driver", "name", fixed("contribution_bps", 6, 3), fixed("share_of_move", 8, 5))
    return shown.groupBy(*shown.columns).agg(F.count("*").alias("copies"))


@query("cadence_progress", """
SELECT w.cadence, coalesce(r.runs, 0) AS runs, coalesce(r.securities, 0) AS tickers_with_runs, w.expected AS expected_windows,
       greatest(w.expected - coalesce(r.runs, 0), 0) AS remaining_windows,
       round(least(coalesce(r.runs, 0) / w.expected * 100.0, 100.0), 4) AS percent_complete
FROM (SELECT cadence, count(*) AS expected FROM all_windows GROUP BY 1) w
LEFT JOIN (SELECT cadence, count(*) AS runs, count(DISTINCT security_id) AS securities FROM win GROUP BY 1) r ON r.cadence = w.cadence""")
def cadence_progress(p: Panels):
    runs, _ = stored(p, expanded=False)
    return reports.cadence_progress(windows.build_windows(seen_bars(p)), runs).select(
        "cadence",
        "runs",
        "tickers_with_runs",
        "expected_windows",
        "remaining_windows",
        F.round("percent_complete", 4).alias("percent_complete"),
    )


@query("coverage_report", """
SELECT cadence, count(*) AS expected, count(*) FILTER (WHERE hit) AS ran, count(*) FILTER (WHERE NOT hit) AS skipped,
       count(*) FILTER (WHERE hit) / count(*) >= 0.95 AS reached
FROM (SELECT a.cadence, w.security_id IS NOT NULL AS hit FROM all_windows a LEFT JOIN win w ON w.security_id = a.security_id
      AND w.cadence = a.cadence AND w.window_start = a.window_start AND w.window_end = a.window_end) x GROUP BY cadence""")
def coverage_report(p: Panels):
    return reports.coverage_report(windows.build_windows(seen_bars(p)), stored(p, expanded=False)[0])


@query("task_progress", """
SELECT CASE WHEN security_id % 3 = 0 THEN 'completed' WHEN security_id % 3 = 1 THEN 'running' ELSE 'pending' END AS status,
       count(*) AS tasks, CAST(sum(n) AS BIGINT) AS expected_windows, CAST(sum(n // 2) AS BIGINT) AS ran_windows, CAST(sum(n % 7) AS BIGINT) AS skipped_windows
FROM (SELECT security_id, cadence, count(*) AS n FROM all_windows GROUP BY 1, 2) t GROUP BY 1""")
def task_progress(p: Panels):
    n = windows.build_windows(seen_bars(p)).groupBy("security_id", "cadence").agg(F.count("*").alias("expected_windows"))
    third = F.col("security_id") % 3
    tasks = n.select(
        F.when(third == 0, "completed").when(third == 1, "running").otherwise("pending").alias("status"),
        "expected_windows",
        F.floor(F.col("expected_windows") / 2).alias("ran_windows"),
        (F.col("expected_windows") % 7).alias("skipped_windows"),
    )
    return reports.task_progress(tasks)


@query("top_skip_reasons", """
SELECT concat(cadence, ': no history') AS skip_reason, count(*) AS count
FROM (SELECT security_id, cadence, window_start, window_end FROM all_windows
      EXCEPT SELECT security_id, cadence, window_start, window_end FROM win) s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2""")
def top_skip_reasons(p: Panels):
    skipped = windows.skipped_windows(windows.build_windows(seen_bars(p)), prepared(p).windows, "no history")
    named = skipped.withColumn("skip_reason", F.concat_ws(": ", "cadence", "skip_reason"))
    return reports.top_skip_reasons(named, 2)


@query("event_windows_daily", """
SELECT security_id, window_start, window_end, count(*) AS events FROM event_hits WHERE cadence = 'daily' GROUP BY ALL""")
def event_windows_daily(p: Panels):
    daily = prepared(p).windows.where("cadence = 'daily'")
    met = events.events_in_windows(daily, p.event, p.security, CUTOFF)
    return met.groupBy("security_id", "window_start", "window_end").agg(F.count("*").alias("events"))

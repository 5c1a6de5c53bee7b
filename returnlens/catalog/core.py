"""Queries over prices, windows, series and the factor models."""

from __future__ import annotations

from pyspark.sql import functions as F

from returnlens.catalog.panels import CUTOFF, Panels
from returnlens.catalog.registry import query
from returnlens.catalog.steps import AT, LOOKBACK
from returnlens.operators import models, peers, pit, returns, series, style, windows
from returnlens.plans import attribution as plan


def market_data(p: Panels) -> plan.MarketData:
    return plan.MarketData(
        bars=p.price_raw,
        factors=p.factor_return,
        securities=p.security,
        macro=p.macro_series,
        classes=p.classification,
        baskets=p.peer_basket,
        members=p.peer_member,
        exposures=p.company_exposure,
        events=p.event,
    )


def settings(**changes) -> plan.Settings:
    return plan.Settings(cutoff=CUTOFF, lookback_days=LOOKBACK, **changes)


def prepared(p: Panels) -> plan.Prepared:
    return plan.prepare(market_data(p), settings())


def seen_bars(p: Panels):
    return pit.visible_bars(p.price_raw, CUTOFF)


def seen_returns(p: Panels):
    return returns.daily_returns(seen_bars(p))


@query("point_in_time_prices", f"""
SELECT security_id, event_date, source, round(adjusted_close, 6) AS adjusted_close FROM price_raw
WHERE timestamp_available <= {AT}""")
def point_in_time_prices(p: Panels):
    seen = pit.visible(p.price_raw, CUTOFF)
    return seen.select("security_id", "event_date", "source", F.round("adjusted_close", 6).alias("adjusted_close"))


@query("active_intervals", """
SELECT ticker, security_id FROM ticker_history WHERE active_from <= TIMESTAMP '1994-06-01 00:00:00'
  AND (active_to IS NULL OR active_to > TIMESTAMP '1994-06-01 00:00:00')""")
def active_intervals(p: Panels):
    return pit.active(p.ticker_history, "1994-06-01 00:00:00").select("ticker", "security_id")


@query("price_dedupe", """
SELECT security_id, event_date, source, round(adjusted_close, 6) AS adjusted_close, volume FROM bars""")
def price_dedupe(p: Panels):
    return seen_bars(p).select(
        "security_id", "event_date", "source", F.round("adjusted_close", 6).alias("adjusted_close"), "volume"
    )


@query("daily_returns", """
SELECT security_id, event_date, prev_date, round(return_bps, 4) AS return_bps FROM rets WHERE return_bps IS NOT NULL""")
def daily_returns(p: Panels):
    return seen_returns(p).where(F.col("return_bps").isNotNull()).select(
        "security_id", "event_date", "prev_date", F.round("return_bps", 4).alias("return_bps")
    )


@query("estimation_returns", f"""
SELECT w.security_id, w.window_start, count(*) AS observations, round(sum(r.return_bps), 4) AS sum_bps
FROM (SELECT DISTINCT security_id, window_start FROM win) w
JOIN rets r ON r.security_id = w.security_id AND r.event_date < w.window_start
  AND r.event_date >= w.window_start - {LOOKBACK} AND r.prev_date >= w.window_start - {LOOKBACK}
GROUP BY ALL""")
def estimation_returns(p: Panels):
    from returnlens.operators.regression import trailing_sums

    moves, y = seen_returns(p), F.col("return_bps")
    sums = trailing_sums(
        moves, ["security_id"], {"n": F.lit(1.0), "s": y}, y.isNotNull(), F.col("prev_date"), LOOKBACK
    )
    starts = prepared(p).windows.select("security_id", "window_start").distinct()
    return (
        sums.withColumnRenamed("event_date", "window_start")
        .join(starts, ["security_id", "window_start"])
        .where("n > 0")
        .select(
            "security_id", "window_start", F.col("n").cast("long").alias("observations"), F.round("s", 4).alias("sum_bps")
        )
    )


@query("attribution_windows", """
SELECT security_id, cadence, window_start, window_end, round(observed_return_bps, 4) AS observed_return_bps FROM observed""")
def attribution_windows(p: Panels):
    built = windows.with_observed_return(windows.build_windows(seen_bars(p)))
    return built.select(*windows.WINDOW, F.round("observed_return_bps", 4).alias("observed_return_bps"))


@query("window_close_to_close", """
SELECT m.security_id, m.window_start, m.window_end, count(*) AS bars,
       round((arg_max(b.adjusted_close, b.event_date) / arg_min(b.adjusted_close, b.event_date) - 1) * 10000, 4)
         AS observed_return_bps
FROM (SELECT DISTINCT security_id, CAST(date_trunc('month', event_date) AS DATE) AS window_start,
        CAST(date_trunc('month', event_date) + INTERVAL 20 DAY AS DATE) AS window_end FROM price_raw) m
JOIN bars b ON b.security_id = m.security_id AND b.event_date BETWEEN m.window_start AND m.window_end
GROUP BY m.security_id, m.window_start, m.window_end HAVING count(*) >= 2""")
def window_close_to_close(p: Panels):
    month = F.trunc("event_date", "month")
    asked = p.price_raw.select(
        "security_id", month.alias("window_start"), F.date_add(month, 20).alias("window_end")
    ).distinct()
    found = returns.window_returns(asked, seen_bars(p))
    return found.select(
        "security_id", "window_start", "window_end", "bars", F.round("observed_return_bps", 4).alias("observed_return_bps")
    )


@query("valid_backfill_windows", """
SELECT security_id, cadence, window_start, window_end FROM win""")
def valid_backfill_windows(p: Panels):
    return prepared(p).windows.select(*windows.WINDOW)


@query("first_windows_per_cadence", """
SELECT security_id, cadence, window_start, window_end FROM (
  SELECT *, row_number() OVER (PARTITION BY security_id, cadence ORDER BY window_start) AS rn FROM all_windows
  WHERE window_start >= DATE '1997-01-01') w WHERE rn <= 10""")
def first_windows_per_cadence(p: Panels):
    built = windows.from_analysis_start(windows.build_windows(seen_bars(p)), "1997-01-01")
    return windows.first_windows(built, 10).select(*windows.WINDOW)


@query("windows_after_checkpoint", """
SELECT w.security_id, w.cadence, w.window_start, w.window_end FROM all_windows w
LEFT JOIN (SELECT security_id, cadence, max(window_end) AS last_end FROM all_windows
           WHERE window_end <= DATE '1999-12-31' AND security_id % 3 <> 0 GROUP BY 1, 2) d
  ON d.security_id = w.security_id AND d.cadence = w.cadence
WHERE d.last_end IS NULL OR w.window_end > d.last_end""")
def windows_after_checkpoint(p: Panels):
    built = windows.build_windows(seen_bars(p))
    stored = built.where("window_end <= DATE '1999-12-31' AND security_id % 3 <> 0")
    return windows.after_checkpoint(built, stored).select(*windows.WINDOW)


@query("windows_not_yet_run", """
SELECT security_id, cadence, window_start, window_end FROM all_windows
WHERE NOT (day(window_end) % 4 = 1 AND security_id % 2 = 0)""")
def windows_not_yet_run(p: Panels):
    built = windows.build_windows(seen_bars(p))
    kinds = F.explode(F.array(F.lit("factor-baseline-v0"), F.lit("other")))
    stored = built.where("day(window_end) % 4 = 1").withColumn("model_version", kinds).where(
        "security_id % 2 = 0 OR model_version = 'other'"
    ).withColumn("factor_basket_version", F.lit("mvp_expanded_v0"))
    return windows.not_yet_run(built, stored, "factor-baseline-v0", "mvp_expanded_v0").select(*windows.WINDOW)


@query("latest_daily_windows", """
SELECT security_id, min(event_date) AS window_start, max(event_date) AS window_end,
       min(event_date) < DATE '1999-06-20' - 10 AS used_far_range
FROM (SELECT security_id, event_date, row_number() OVER (PARTITION BY security_id ORDER BY event_date DESC) AS rn
      FROM bars WHERE event_date <= DATE '1999-06-20' AND event_date >= DATE '1999-06-20' - 30) b
WHERE rn <= 2 GROUP BY security_id HAVING count(*) = 2""")
def latest_daily_windows(p: Panels):
    return windows.latest_windows(seen_bars(p), "1999-06-20").select(
        "security_id", "window_start", "window_end", "used_far_range"
    )


@query("factor_pairs", """
SELECT r.security_id, r.event_date, round(r.return_bps, 4) AS return_bps, round(f.value, 6) AS market_bps
FROM rets r JOIN fac f ON f.event_date = r.event_date AND f.series_key = 'Mkt-RF' WHERE r.return_bps IS NOT NULL""")
def factor_pairs(p: Panels):
    market = prepared(p).series.where("series_key = 'Mkt-RF'").select("event_date", F.col("value").alias("market_bps"))
    return seen_returns(p).where("return_bps IS NOT NULL").join(market, "event_date").select(
        "security_id", "event_date", F.round("return_bps", 4).alias("return_bps"), F.round("market_bps", 6).alias("market_bps")
    )


@query("factor_moves", """
SELECT w.security_id, w.cadence, w.window_start, w.window_end, round(coalesce(sum(f.value), 0.0), 6) AS factor_move
FROM all_windows w LEFT JOIN fac f ON f.series_key = 'SMB' AND f.event_date > w.window_start
  AND f.event_date <= w.window_end GROUP BY ALL""")
def factor_moves(p: Panels):
    smb = series.factor_series(pit.visible_factor_returns(p.factor_return, CUTOFF)).where("series_key = 'SMB'")
    asked = windows.build_windows(seen_bars(p)).withColumn("series_key", F.lit("SMB"))
    return series.attach_moves(asked, smb).select(*windows.WINDOW, F.round("factor_move", 6).alias("factor_move"))


@query("trailing_market_beta", f"""
SELECT w.security_id, w.window_start, count(*) AS observations, round(regr_slope(r.return_bps, f.value), 6) AS beta
FROM (SELECT DISTINCT security_id, window_start FROM win) w
JOIN rets r ON r.security_id = w.security_id AND r.event_date < w.window_start
  AND r.event_date >= w.window_start - {LOOKBACK} AND r.prev_date >= w.window_start - {LOOKBACK}
JOIN fac f ON f.event_date = r.event_date AND f.series_key = 'Mkt-RF'
GROUP BY ALL HAVING count(*) >= 2""")
def trailing_market_beta(p: Panels):
    from returnlens.operators.regression import trailing_betas

    ready = prepared(p)
    betas = trailing_betas(
        ready.returns,
        models.market_assignments(p.security).select("security_id", "series_key"),
        ready.series.where("series_key = 'Mkt-RF'"),
        LOOKBACK,
    )
    starts = ready.windows.select("security_id", "window_start").distinct()
    return betas.join(starts, ["security_id", "window_start"]).select(
        "security_id", "window_start", "observations", F.round("beta", 6).alias("beta")
    )


@query("five_factor_betas", """
SELECT security_id, window_start, observations, round(b1, 6) AS mkt, round(b2, 6) AS smb, round(b3, 6) AS hml,
       round(b4, 6) AS rmw, round(b5, 6) AS cma FROM five_fit""")
def five_factor_betas(p: Panels):
    from returnlens.operators.regression import multi_betas, trailing_moments
    from returnlens.vocab import FIVE_FACTORS

    ready = prepared(p)
    wide, columns = models.wide_factors(ready.series, FIVE_FACTORS)
    fits = multi_betas(trailing_moments(ready.returns, wide, columns, LOOKBACK), 5, 10)
    starts = ready.windows.select("security_id", "window_start").distinct()
    named = ["mkt", "smb", "hml", "rmw", "cma"]
    return fits.join(starts, ["security_id", "window_start"]).select(
        "security_id",
        "window_start",
        "observations",
        *[F.round(F.get("betas", F.lit(i)), 6).alias(n) for i, n in enumerate(named)],
    )


@query("macro_changes", """
SELECT series_key, event_date, prev_date, round(value, 4) AS value FROM macro_moves""")
def macro_changes(p: Panels):
    moves = series.macro_factor_series(pit.visible_macro(p.macro_series, CUTOFF))
    return moves.select("series_key", "event_date", "prev_date", F.round("value", 4).alias("value"))


@query("macro_curve_spread", """
SELECT event_date, round(value, 6) AS value FROM macro_levels WHERE series_key = 'macro:2s10s_curve_change'""")
def macro_curve_spread(p: Panels):
    curve = series.spread(pit.visible_macro(p.macro_series, CUTOFF), "DGS10", "DGS2", "curve")
    return curve.select("event_date", F.round("value", 6).alias("value"))


@query("proxy_factor_returns", """
SELECT x.factor_name, r.event_date, round(r.return_bps, 4) AS return_bps, concat('proxy_price:', x.ticker) AS source
FROM (SELECT concat('sector:', sector) AS factor_name, min(ticker) AS ticker FROM security GROUP BY sector
      UNION ALL SELECT concat('industry:', sector, '/any'), min(ticker) FROM security GROUP BY sector) x
JOIN (SELECT ticker, security_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker
        ORDER BY active_from DESC, security_id) AS rn FROM ticker_history WHERE active_to IS NULL) t WHERE rn = 1) h
  ON h.ticker = x.ticker
JOIN rets r ON r.security_id = h.security_id WHERE r.return_bps IS NOT NULL""")
def proxy_factor_returns(p: Panels):
    by_sector = p.security.groupBy("sector").agg(F.min("ticker").alias("ticker"))
    proxies = by_sector.select(F.concat(F.lit("sector:"), "sector").alias("factor_name"), "ticker").unionByName(
        by_sector.select(F.concat(F.lit("industry:"), "sector", F.lit("/any")).alias("factor_name"), "ticker")
    )
    made = series.proxy_factor_returns(seen_bars(p), pit.active_ticker_map(p.ticker_history), proxies)
    return made.select("factor_name", "event_date", F.round("return_bps", 4).alias("return_bps"), "source")


FIT_COLUMNS = """security_id, cadence, window_start, window_end, driver, name, observations, round(beta, 6) AS beta,
       round(move, 6) AS factor_move, round(contribution_bps, 4) AS contribution_bps"""


def fit_view(rows, move_decimals=6):
    return rows.select(
        *windows.WINDOW,
        "driver",
        "name",
        "observations",
        F.round("beta", 6).alias("beta"),
        F.round("factor_move", move_decimals).alias("factor_move"),
        F.round("contribution_bps", 4).alias("contribution_bps"),
        "confidence",
    )


def simple_rows(p: Panels, assigned, all_series=None):
    ready = prepared(p)
    return models.simple_factor_rows(
        ready.windows, ready.returns, assigned, all_series or ready.series, LOOKBACK, CUTOFF
    )


@query("market_model", f"SELECT {FIT_COLUMNS}, 'Medium' AS confidence FROM fits_assigned_market_market")
def market_model(p: Panels):
    return fit_view(plan.market_rows(market_data(p), settings(), prepared(p)))


@query("five_factor_model", f"SELECT {FIT_COLUMNS}, 'Medium' AS confidence FROM fits_five")
def five_factor_model(p: Panels):
    ready = prepared(p)
    return fit_view(models.five_factor_rows(ready.windows, ready.returns, ready.series, LOOKBACK, CUTOFF))


@query("sector_industry_model", f"SELECT {FIT_COLUMNS}, 'High' AS confidence FROM fits_assigned_sector")
def sector_industry_model(p: Panels):
    return fit_view(simple_rows(p, models.sector_assignments(p.classification, CUTOFF)))


@query("peer_basket_model", f"SELECT {FIT_COLUMNS}, 'High' AS confidence FROM fits_assigned_peer")
def peer_basket_model(p: Panels):
    ready = prepared(p)
    compositions, moves = plan.peer_parts(market_data(p), ready.returns, CUTOFF)
    return fit_view(simple_rows(p, models.peer_assignments(compositions), moves))


MACRO_COLUMNS = FIT_COLUMNS.replace("round(move, 6)", "round(move, 4)")


@query("macro_model", f"SELECT {MACRO_COLUMNS}, 'High' AS confidence FROM fits_assigned_macro")
def macro_model(p: Panels):
    return fit_view(simple_rows(p, models.macro_assignments(p.security, p.company_exposure, CUTOFF)), 4)


@query("peer_weights", """
SELECT target_security_id, peer_security_id, round(weight, 6) AS weight, active_members FROM weights""")
def peer_weights(p: Panels):
    members = peers.active_members(p.peer_basket, p.peer_member, CUTOFF)
    return peers.normalised_weights(members, CUTOFF).select(
        "target_security_id", "peer_security_id", F.round("weight", 6).alias("weight"), "active_members"
    )


@query("peer_basket_members", """
SELECT target_security_id, basket_name, basket_version, peer_security_id FROM seen_members
WHERE target_security_id IN (SELECT target_security_id FROM seen_members GROUP BY 1 HAVING count(*) >= 3)""")
def peer_basket_members(p: Panels):
    return peers.active_members(p.peer_basket, p.peer_member, CUTOFF).select(
        "target_security_id", "basket_name", "basket_version", "peer_security_id"
    )


@query("peer_basket_returns", """
SELECT target_security_id, event_date, round(value, 4) AS value FROM peer_moves""")
def peer_basket_returns(p: Panels):
    compositions, moves = plan.peer_parts(market_data(p), seen_returns(p), CUTOFF)
    return compositions.join(moves, "series_key").select(
        "target_security_id", "event_date", F.round("value", 4).alias("value")
    )


@query("macro_exposure_gates", "SELECT security_id, series_key, round(gate, 4) AS gate FROM gates")
def macro_exposure_gates(p: Panels):
    from returnlens.operators.exposures import macro_gates

    return macro_gates(p.security, p.company_exposure, CUTOFF).select(
        "security_id", "series_key", F.round("gate", 4).alias("gate")
    )


@query("run_classification", "SELECT security_id, sector, industry FROM classes")
def run_classification(p: Panels):
    return pit.latest_classification(p.classification, CUTOFF).select("security_id", "sector", "industry")


@query("summary_classification", """
SELECT security_id, sector, industry FROM (SELECT *, row_number() OVER (PARTITION BY security_id
  ORDER BY timestamp_available DESC, event_date DESC) AS rn FROM classification) c WHERE rn = 1""")
def summary_classification(p: Panels):
    return pit.latest_classification(p.classification).select("security_id", "sector", "industry")


@query("active_ticker_security", """
SELECT ticker, security_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker
  ORDER BY active_from DESC, security_id) AS rn FROM ticker_history WHERE active_to IS NULL) t WHERE rn = 1""")
def active_ticker_security(p: Panels):
    return pit.active_ticker_map(p.ticker_history).select("ticker", "security_id")


@query("ticker_change_resolution", """
SELECT ticker, security_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker
  ORDER BY active_from DESC, security_id) AS rn FROM ticker_history
  WHERE active_from <= TIMESTAMP '1993-03-01 00:00:00'
    AND (active_to IS NULL OR active_to > TIMESTAMP '1993-03-01 00:00:00')) t WHERE rn = 1""")
def ticker_change_resolution(p: Panels):
    return pit.ticker_map_on(p.ticker_history, "1993-03-01 00:00:00").select("ticker", "security_id")


@query("close_at_window_edges", """
SELECT w.security_id, w.cadence, w.window_start, w.window_end, round(s.adjusted_close, 6) AS start_close,
       round(e.adjusted_close, 6) AS end_close
FROM all_windows w LEFT JOIN bars s ON s.security_id = w.security_id AND s.event_date = w.window_start
LEFT JOIN bars e ON e.security_id = w.security_id AND e.event_date = w.window_end""")
def close_at_window_edges(p: Panels):
    asked = windows.build_windows(seen_bars(p)).select(*windows.WINDOW)
    started = pit.close_at(asked, p.price_raw, "window_start", CUTOFF, "start_close")
    both = pit.close_at(started, p.price_raw, "window_end", CUTOFF, "end_close")
    return both.select(
        *windows.WINDOW, F.round("start_close", 6).alias("start_close"), F.round("end_close", 6).alias("end_close")
    )


@query("style_descriptors_history", """
SELECT security_id, event_date, d.descriptor, round(d.value, 4) AS value, d.observations, d.confidence FROM (
  SELECT b.security_id, b.event_date, b.n, unnest([
    {'descriptor': 'momentum', 'value': CASE WHEN n >= 252 THEN (c21 / c252 - 1) * 10000 ELSE (c5 / c0 - 1) * 10000 END,
     'observations': n, 'confidence': CASE WHEN n >= 252 THEN 'Medium-High' WHEN n >= 126 THEN 'Medium' ELSE 'Low-Medium' END},
    {'descriptor': 'short_term_reversal', 'value': -((adjusted_close / CASE WHEN n >= 21 THEN c21 ELSE c0 END - 1) * 10000),
     'observations': least(n, 21), 'confidence': CASE WHEN n >= 21 THEN 'Medium-High' WHEN n >= 20 THEN 'Medium' ELSE 'Low-Medium' END},
    {'descriptor': 'realized_volatility', 'value': vol * sqrt(252.0),
     'observations': least(n, 60), 'confidence': CASE WHEN n >= 60 THEN 'Medium-High' WHEN n >= 30 THEN 'Medium' ELSE 'Low-Medium' END},
    {'descriptor': 'liquidity', 'value': ln(1 + adv),
     'observations': least(n + 1, 60), 'confidence': CASE WHEN n + 1 >= 60 THEN 'Medium-High' WHEN least(n + 1, 60) >= 30 THEN 'Medium' ELSE 'Low-Medium' END}
    ]) AS d
  FROM (SELECT r.security_id, r.event_date, r.adjusted_close,
          row_number() OVER w - 1 AS n, lag(r.adjusted_close, 5) OVER w AS c5, lag(r.adjusted_close, 21) OVER w AS c21,
          lag(r.adjusted_close, 252) OVER w AS c252, first_value(r.adjusted_close) OVER w AS c0,
          stddev_pop(r.return_bps) OVER (PARTITION BY r.security_id ORDER BY r.event_date ROWS 59 PRECEDING) AS vol,
          avg(r.adjusted_close * b.volume) OVER (PARTITION BY r.security_id ORDER BY r.event_date ROWS 59 PRECEDING) AS adv
        FROM rets r JOIN bars b ON b.security_id = r.security_id AND b.event_date = r.event_date
        WINDOW w AS (PARTITION BY r.security_id ORDER BY r.event_date)) b WHERE n >= 20) x""")
def style_descriptors_history(p: Panels):
    return style.history_descriptors(seen_bars(p)).select(
        "security_id", "event_date", "descriptor", F.round("value", 4).alias("value"), "observations", "confidence"
    )


STYLE_WINDOW_SQL = f"""
SELECT w.security_id, w.cadence, w.window_start, w.window_end, w.observed_return_bps, count(*) - 1 AS n,
       list(b.adjusted_close ORDER BY b.event_date) AS closes,
       list(b.adjusted_close * b.volume ORDER BY b.event_date) AS dollars
FROM win w JOIN bars b ON b.security_id = w.security_id AND b.event_date >= w.window_start - {LOOKBACK}
 AND b.event_date <= w.window_end GROUP BY ALL HAVING count(*) >= 21"""


@query("style_descriptors_window", f"""
SELECT security_id, cadence, window_start, window_end, d.name, round(d.value, 4) AS value, d.observations FROM (
  SELECT security_id, cadence, window_start, window_end, unnest([
    {{'name': 'Style descriptor (momentum)', 'observations': n,
      'value': CASE WHEN n >= 252 THEN (closes[n + 1 - 21] / closes[n + 1 - 252] - 1) * 10000
                    ELSE (closes[n + 1 - 5] / closes[1] - 1) * 10000 END}},
    {{'name': 'Style descriptor (short_term_reversal)', 'observations': least(n, 21),
      'value': -((closes[n + 1] / closes[greatest(n + 1 - 21, 1)] - 1) * 10000)}},
    {{'name': 'Style descriptor (realized_volatility)', 'observations': least(n, 60),
      'value': list_aggregate(list_transform(range(greatest(n - 60, 0) + 1, n + 1),
                 lambda i: (closes[i + 1] / closes[i] - 1) * 10000), 'stddev_pop') * sqrt(252.0)}},
    {{'name': 'Style descriptor (liquidity)', 'observations': least(n + 1, 60),
      'value': ln(1 + list_avg(dollars[greatest(n + 1 - 59, 1):n + 1]))}}]) AS d
  FROM ({STYLE_WINDOW_SQL}) s) x""")
def style_descriptors_window(p: Panels):
    ready = prepared(p)
    rows = models.style_rows(ready.windows, ready.bars, LOOKBACK, CUTOFF)
    return rows.select(*windows.WINDOW, "name", F.round("beta", 4).alias("value"), "observations")

"""Known answers on hand-made rows."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from returnlens.functions import identity, parsing, scoring
from returnlens.operators import assemble, models, peers, pit, quality, regression, returns, series, style, universe, upsert, windows
from returnlens.operators.events import classify, event_surprises
from returnlens.sources import feeds

D = dt.date
CUTOFF = "2026-12-31 00:00:00"
AVAILABLE = dt.datetime(2026, 1, 1)


def days(n, start=D(2026, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def bars(spark, rows):
    """rows: (security, date, price[, available[, source]])"""
    full = [
        (s, d, float(x), float(x), 100, "USD", (rest[1] if len(rest) > 1 else "a"),
         rest[0] if rest else dt.datetime(2026, 1, 1), rest[0] if rest else dt.datetime(2026, 1, 1))
        for s, d, x, *rest in rows
    ]
    return spark.createDataFrame(
        full,
        "security_id int, event_date date, close double, adjusted_close double, volume long, currency string, "
        "source string, ingestion_time timestamp_ntz, timestamp_available timestamp_ntz",
    )


def window(spark, start, end, observed=0.0, security=1):
    return spark.createDataFrame(
        [(security, "daily", start, end, observed)],
        "security_id int, cadence string, window_start date, window_end date, observed_return_bps double",
    )


def price_path(security, dates, moves_bps, first=100.0):
    out, price = [(security, dates[0], first)], first
    for d, m in zip(dates[1:], moves_bps):
        price *= 1 + m / 10_000
        out.append((security, d, price))
    return out


def series_rows(spark, rows):
    return spark.createDataFrame(rows, "series_key string, event_date date, value double, prev_date date")


def test_close_to_close(spark):
    b = bars(spark, [(1, D(2026, 1, 2), 50), (1, D(2026, 1, 5), 60)])
    asked = spark.createDataFrame([(1, D(2026, 1, 1), D(2026, 1, 6))], "security_id int, window_start date, window_end date")
    assert returns.window_returns(asked, b).first().observed_return_bps == pytest.approx(2000)
    late = bars(spark, [(1, D(2026, 1, 2), 50), (1, D(2026, 1, 5), 60, dt.datetime(2027, 1, 1))])
    assert returns.window_returns(asked, pit.visible_bars(late, CUTOFF)).count() == 0


def test_latest_visible_bar_wins(spark):
    b = bars(spark, [
        (1, D(2026, 1, 2), 255.0, dt.datetime(2026, 1, 3), "b"),
        (1, D(2026, 1, 2), 255.63, dt.datetime(2026, 1, 4), "a"),
        (1, D(2026, 1, 2), 999.0, dt.datetime(2027, 6, 1), "a"),
        (1, D(2026, 1, 5), 255.92, dt.datetime(2026, 1, 6), "a"),
        (1, D(2026, 1, 5), 111.0, dt.datetime(2026, 1, 6), "b"),
    ])
    got = {r.event_date.day: r.adjusted_close for r in pit.visible_bars(b, CUTOFF).collect()}
    assert got == {2: 255.63, 5: 255.92}


def test_windows(spark):
    b = bars(spark, [(1, D(2026, 1, d), 10 + d) for d in (2, 5, 6)])
    daily = windows.build_windows(b, ["daily"]).orderBy("window_start").collect()
    assert [(r.window_start.day, r.window_end.day) for r in daily] == [(2, 5), (5, 6)]
    b = bars(spark, [(1, D(2026, 1, d), 10 + d) for d in (5, 6, 12, 13, 19)])
    weekly = windows.build_windows(b, ["weekly"]).orderBy("window_start").collect()
    assert [(r.window_start.day, r.window_end.day) for r in weekly] == [(5, 6), (12, 13)]
    with pytest.raises(ValueError):
        windows.build_windows(b, ["hourly"])


def simple(spark, driver, x, y, move, pairs_needed):
    """One window after the given paired history; returns its contribution rows."""
    dates = days(len(x) + 2)
    b = bars(spark, price_path(1, dates, [*y, 0.0]))
    s = series_rows(spark, [("f", d, float(v), None) for d, v in zip(dates[1:], [*x, move])])
    assigned = spark.createDataFrame(
        [(1, "f", driver, "name", 1.0, None, None)],
        "security_id int, series_key string, driver string, name string, gate double, basket_name string, basket_version string",
    )
    w = window(spark, dates[-2], dates[-1])
    return models.simple_factor_rows(w, returns.daily_returns(b), assigned, s, 60, CUTOFF).collect()


def test_market_beta_two(spark):
    x = [1.0, 2.0, -1.0, 4.0, 3.0, -2.0, 5.0]
    row = simple(spark, "market", x, [2 * v for v in x], -3.0, 5)[0]
    assert row.contribution_bps == pytest.approx(-6.0, abs=1e-6)
    assert row.confidence == "Medium" and row.observations == 6


def test_sector_beta_two_and_minimum(spark):
    x = [float(i % 5 - 2) for i in range(13)]
    row = simple(spark, "sector", x, [2 * v for v in x], 14.0, 10)[0]
    assert row.contribution_bps == pytest.approx(28.0, abs=1e-6)
    assert simple(spark, "sector", x[:8], [2 * v for v in x[:8]], 14.0, 10) == []


def test_flat_factor_gives_zero_row(spark):
    row = simple(spark, "market", [1.0] * 8, [1.0, 2.0, 3.0, 4.0, 3.0, 2.0, 1.0, 2.0], 5.0, 5)[0]
    assert row.beta == 0.0 and row.contribution_bps == 0.0


def test_peer_basket(spark):
    weights = spark.createDataFrame(
        [(9, "b", "v", 1, 0.75, 2), (9, "b", "v", 2, 0.25, 2)],
        "target_security_id int, basket_name string, basket_version string, peer_security_id int, weight double, active_members long",
    )
    d = days(3)
    moves = returns.daily_returns(bars(spark, [*price_path(1, d, [10, 10]), *price_path(2, d[:2], [30])]))
    got = peers.basket_returns(weights, peers.basket_compositions(weights), moves).collect()
    assert len(got) == 1 and got[0].value == pytest.approx(15.0)


def test_macro_changes(spark):
    v = series_rows(spark, [("m", D(2026, 1, 1), 4.0, None), ("m", D(2026, 1, 2), 4.1, None)])
    assert series.level_changes(v, 100.0).first().value == pytest.approx(10.0)
    z = series_rows(spark, [("m", D(2026, 1, 1), 0.0, None), ("m", D(2026, 1, 2), 4.1, None)])
    assert series.percent_changes(z).count() == 0


def rows_for(spark, items):
    base = window(spark, D(2026, 1, 5), D(2026, 1, 6), items[0][2])
    parts = None
    for driver, bps, observed in items:
        one = models.contribution_rows(base, "2026-02-01 00:00:00", driver=F.lit(driver), name=F.lit(driver),
                                       contribution_bps=F.lit(float(bps)), confidence=F.lit("Medium"))
        parts = one if parts is None else parts.unionByName(one)
    return base, parts


def test_residual(spark):
    base, rows = rows_for(spark, [("market", 100, 400.0), ("sector", 50, 400.0)])
    got = {r.driver: r for r in assemble.contributions(base, rows, "2026-02-01 00:00:00", False).collect()}
    assert got["unexplained_residual"].contribution_bps == pytest.approx(250)
    assert got["market"].share_of_move == pytest.approx(0.25)
    assert got["unexplained_residual"].confidence == "Low"


def test_small_moves_hide_shares(spark):
    base, rows = rows_for(spark, [("market", -69, 1.0)])
    got = assemble.contributions(base, rows, "2026-02-01 00:00:00", True).collect()
    assert all(r.share_of_move is None for r in got)
    assert '"residual_leverage":2.8' in got[0].evidence_payload
    base, rows = rows_for(spark, [("market", -4, 2.0)])
    rest = [r for r in assemble.contributions(base, rows, "2026-02-01 00:00:00", True).collect() if r.driver.startswith("un")][0]
    assert rest.contribution_bps == pytest.approx(6) and rest.confidence == "Medium"


def test_runs_reconcile_and_store_once(spark):
    base, rows = rows_for(spark, [("market", 100, 400.0), ("sector", 50, 400.0)])
    parts = assemble.contributions(base, rows, "2026-02-01 00:00:00", False)
    runs = assemble.runs(base, parts, "2026-02-01 00:00:00", "legacy")
    kept = assemble.stored_contributions(runs, parts)
    assert quality.reconciliation_breaks(runs, kept).count() == 0
    assert quality.reconciliation_breaks(runs, kept.where("driver <> 'sector'")).first().problem == "does not reconcile"
    again_runs, again_parts = upsert.store_results(runs, kept, runs, kept)
    assert again_runs.count() == 1 and again_parts.count() == kept.count() == 3
    text = assemble.narratives(runs, kept).first().narrative
    assert text.startswith("Observed move was 400.0 bps over the selected window. Largest modeled drivers were market (100.0 bps)")
    assert "large relative to the move" in text


def test_lookahead_payload(spark):
    base, rows = rows_for(spark, [("market", 100, 400.0)])
    parts = assemble.contributions(base, rows, "2026-02-01 00:00:00", False)
    runs = assemble.runs(base, parts, "2026-02-01 00:00:00", "legacy")
    kept = assemble.stored_contributions(runs, parts)
    early = kept.withColumn("evidence_payload", F.lit('{"timestamp_available": "2026-01-30T00:00:00Z"}'))
    late = kept.withColumn("evidence_payload", F.lit('{"timestamp_available": "2026-03-01T00:00:00Z"}'))
    assert quality.lookahead_breaks(runs, early).count() == 0
    assert quality.lookahead_breaks(runs, late).count() == 2
    assert quality.missing_pit_columns(bars(spark, [(1, D(2026, 1, 1), 1)])) == ["event_time"]


def test_item_code_and_surprise(spark):
    e = spark.createDataFrame([(1, "8-k", '{"item": " 2.02 "}'), (2, "SC 13D", None), (3, "S-1", "{}")],
                              "event_id int, event_type string, structured_payload string")
    got = {r.event_id: r for r in classify(e).collect()}
    assert got[1].event_category == "earnings" and got[2].event_category == "ownership"
    assert (got[3].event_category, got[3].materiality) == ("general_disclosure", 0.25)
    f = spark.createDataFrame([(1, 1.10, 1.00, None)], "event_id int, actual_value double, expected_value double, scale double")
    s = event_surprises(f).first()
    assert s.surprise_value == pytest.approx(0.10) and s.direction == "positive"


def test_gates_and_short_interest(spark):
    one = spark.range(1)
    gate = one.select(scoring.commodity_gate(F.lit(0.5), F.lit(0.1), F.lit(0.25)).alias("g")).first().g
    assert gate.gate_weight == 1.0 and gate.expected_sign == "positive"
    s = one.select(
        scoring.days_to_cover(F.lit(10e6), F.lit(2e6)).alias("d"),
        scoring.short_interest_share(F.lit(10e6), F.lit(100e6)).alias("f"),
        scoring.confidence_after(scoring.factor_penalty(F.lit(5), 10, F.lit(31.0), F.lit(True), F.lit(True), F.lit(True))).alias("c"),
    ).first()
    assert (s.d, s.f, s.c) == (5.0, pytest.approx(0.10), "Low")


def test_uuid_matches_python(spark):
    names = ["security:AAPL", "company:0000320193", "ticker:ä"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.u for r in df.select(identity.name_uuid(uuid.NAMESPACE_DNS, F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_text_times(spark):
    text = ["2026-01-02T03:04:05Z", "2026-01-02T03:04:05+02:00", "2026-01-02", "", "nonsense", "2026-01-02 03:04:05"]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    got = [r.m for r in df.select(parsing.utc_timestamp(F.col("t")).alias("m")).collect()]
    at = dt.datetime(2026, 1, 2, 3, 4, 5)
    assert got == [at, at - dt.timedelta(hours=2), dt.datetime(2026, 1, 2), None, None, at]


def test_five_factor_file(spark, tmp_path):
    (tmp_path / "f.csv").write_text(
        "made by hand\n\n,Mkt-RF,SMB,HML,RMW,CMA,RF\n20260102, 0.10,-0.20,0.30,-99.99,,0.01\n20260105,1.0,1,1,1,1,1\n\nCopyright\n20260106,9,9\n"
    )
    got = feeds.parse_five_factors(feeds.read_payloads(spark, str(tmp_path)), "2026-01-01", "2026-01-04", "2026-02-01 00:00:00")
    assert {r.factor_name: round(r.return_bps, 6) for r in got.collect()} == {"Mkt-RF": 10.0, "SMB": -20.0, "HML": 30.0, "RF": 1.0}


def test_universe_file(spark, tmp_path):
    (tmp_path / "u.json").write_text(
        '{"version": "v", "source": "s", "active_from": "2020-01-01", "securities": [\n'
        '{"ticker": " brk.b ", "name": "B", "cik": "1067983", "sector": "Financials", "industry": " Diversified  Financials "}]}'
    )
    row = feeds.read_universe(spark, str(tmp_path / "u.json")).first()
    assert (row.ticker, row.cik, row.subindustry, row.exchange) == ("BRK.B", "0001067983", "Diversified Financials", "UNKNOWN")


def test_style_gate(spark):
    d = days(20)
    assert style.history_descriptors(bars(spark, [(1, x, 100 + i) for i, x in enumerate(d)])).count() == 0
    d = days(21)
    got = style.history_descriptors(bars(spark, [(1, x, 100 + i) for i, x in enumerate(d)])).collect()
    assert {r.descriptor for r in got} == {"momentum", "short_term_reversal", "realized_volatility", "liquidity"}
    by = {r.descriptor: r for r in got}
    assert by["momentum"].value == pytest.approx((115 / 100 - 1) * 10_000)
    assert by["short_term_reversal"].value == pytest.approx(-(120 / 100 - 1) * 10_000)


def test_solve_matches_least_squares():
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 3))
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=40)
    z = np.column_stack([np.ones(40), x, y])
    packed = np.array([[(z[:, i] * z[:, j]).sum() for i, j in regression.moment_names(3)]])
    betas, condition = regression.solve_moments(packed, 3)
    expected = np.linalg.lstsq(np.column_stack([np.ones(40), x]), y, rcond=None)[0][1:]
    assert np.allclose(betas[0], expected) and condition[0] == pytest.approx(np.linalg.cond(x))
    flat = np.column_stack([np.ones(40), x[:, :2], x[:, 1] * 2, y])
    packed = np.array([[(flat[:, i] * flat[:, j]).sum() for i, j in regression.moment_names(3)]])
    betas, condition = regression.solve_moments(packed, 3)
    expected = np.linalg.lstsq(flat[:, :4], y, rcond=None)[0][1:]
    assert np.allclose(betas[0], expected, atol=1e-6) and condition[0] > 30


def test_eligibility_needs_active_dollar_stock(spark):
    rows = spark.createDataFrame([("Stock", "usd", True), ("ETF", "USD", True), ("stock", "KRW", True), ("stock", "USD", None)],
                                 "asset_type string, currency string, is_active boolean")
    assert rows.where(universe.is_active_dollar_stock()).count() == 1

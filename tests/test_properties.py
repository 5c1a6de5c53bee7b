"""Rolling path against literal reading, layered model against brute force, skew, replay and streaming."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnlens.catalog.core import market_data, settings
from returnlens.catalog.panels import Panels
from returnlens.operators import hierarchical, models, peers, pit, regression, reports, returns
from returnlens.plans import attribution as plan
from returnlens.streaming.prices import append_prices, landed_prices
from tests.test_golden import CUTOFF, D, bars, days, price_path, series_rows

SF = "/root/testdata/sf0.001"


def gappy(spark, n=300, securities=(1, 2)):
    rng = random.Random(5)
    rows = []
    for s in securities:
        kept = [d for d in days(n) if rng.random() < 0.6]
        rows += price_path(s, kept, [rng.gauss(0, 100) for _ in kept])
    b = bars(spark, rows)
    factor = [d for d in days(n) if rng.random() < 0.7]
    values = [(("f"), d, rng.gauss(0, 50), None) for d in factor]
    return b, series_rows(spark, values), values


@pytest.mark.parametrize("lookback", [5, 40, 120])
def test_rolling_equals_range_join(spark, lookback):
    b, s, _ = gappy(spark)
    moves = returns.daily_returns(b)
    assigned = moves.select("security_id", F.lit("f").alias("series_key")).distinct()
    fast = regression.trailing_betas(moves, assigned, s, lookback).collect()
    pairs = moves.where("return_bps IS NOT NULL").join(s.select("event_date", F.col("value").alias("x")), "event_date")
    starts = moves.select("security_id", F.col("event_date").alias("window_start"))
    slow = regression.literal_betas(starts, pairs, lookback).where("observations >= 2").collect()
    left = {(r.security_id, r.window_start): (r.observations, r.beta) for r in fast}
    right = {(r.security_id, r.window_start): (r.observations, r.beta) for r in slow}
    assert left.keys() == right.keys() and left
    for key, (n, beta) in left.items():
        assert n == right[key][0] and beta == pytest.approx(right[key][1], rel=1e-9, abs=1e-9)


def test_changes_need_their_earlier_observation(spark):
    """A change measured against an observation before the lookback does not count."""
    rng = random.Random(8)
    b, _, _ = gappy(spark, 200, (1,))
    seen = [d for d in days(200) if rng.random() < 0.3]
    change = [("f", d, rng.gauss(0, 1), p) for p, d in zip(seen, seen[1:])]
    moves = returns.daily_returns(b)
    assigned = spark.createDataFrame([(1, "f")], "security_id int, series_key string")
    fast = {r.window_start: r.observations for r in
            regression.trailing_betas(moves, assigned, series_rows(spark, change), 30).collect()}
    own = [(r.event_date, r.prev_date) for r in moves.collect()]
    by_day = {d: p for _, d, _, p in change}
    for start, _ in own:
        low = start - dt.timedelta(days=30)
        n = sum(1 for d, p in own if p and low <= d < start and p >= low and d in by_day and by_day[d] >= low)
        assert fast.get(start, 0) == (n if n >= 2 else 0)


def brute_residual(target, priors, low, start):
    dates = [d for d in sorted(target) if low <= d < start and all(d in p for p in priors)]
    if not priors or len(dates) <= len(priors) + 1:
        return dict(target)
    x = np.array([[1.0, *[p[d] for p in priors]] for d in dates])
    coef = np.linalg.lstsq(x, np.array([target[d] for d in dates]), rcond=None)[0]
    return {d: v - np.dot([1.0, *[p[d] for p in priors]], coef) for d, v in target.items() if all(d in p for p in priors)}


def test_layered_model_matches_brute_force(spark):
    rng = np.random.default_rng(11)
    n = 220
    d = days(n)
    keys = ["Mkt-RF", "SMB", "HML", "RMW", "CMA", "sector:X", "macro:vix_return"]
    data = {k: {x: float(rng.normal(0, 40)) for x in d[1:] if rng.random() < 0.95} for k in keys}
    stock = [0.5 * data["Mkt-RF"].get(x, 0) + 0.8 * data["sector:X"].get(x, 0) + float(rng.normal(0, 10)) for x in d[1:]]
    b = bars(spark, price_path(1, d, stock))
    s = series_rows(spark, [(k, x, v, None) for k in keys for x, v in data[k].items()])
    layers = spark.createDataFrame(
        [(1, "sector:X", "sector", "S", 1.0, 0), (1, "industry:none", "sector", "I", 1.0, 1), (1, "macro:vix_return", "macro", "M", 0.5, 8)],
        "security_id int, series_key string, driver string, name string, gate double, layer int",
    ).where("layer <> 1")
    asked = [(d[i], d[i + 3]) for i in (110, 150, 215)]
    w = spark.createDataFrame([(1, "daily", a, e, 0.0) for a, e in asked],
                              "security_id int, cadence string, window_start date, window_end date, observed_return_bps double")
    moves = returns.daily_returns(b)
    got = {(r.window_start, r.name): r for r in hierarchical.layered_rows(w, moves, layers, s, 100, CUTOFF).collect()}
    own = {r.event_date: (r.return_bps, r.prev_date) for r in moves.collect() if r.return_bps is not None}
    for start, end in asked:
        low = start - dt.timedelta(days=100)
        inside = {k: {x: v for x, v in data[k].items() if low <= x <= end} for k in keys}
        priors = [inside[k] for k in keys[:5]]
        for key, name, gate in (("sector:X", "S", 1.0), ("macro:vix_return", "M", 0.5)):
            res = brute_residual(inside[key], priors, low, start)
            pairs = [(own[x][0], res[x]) for x in sorted(res) if low <= x < start and x in own and own[x][1] >= low]
            priors.append(res)
            assert len(pairs) >= 60
            y, x = np.array(pairs).T
            beta = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
            move = sum(v for k, v in res.items() if start < k <= end)
            row = got[(start, name)]
            assert row.observations == len(pairs)
            assert row.contribution_bps == pytest.approx(beta * move * gate, rel=1e-6, abs=1e-6)


def test_missing_layer_series_falls_back(spark):
    """An assigned sector without any return empties the priors, so later layers use raw values."""
    rng = np.random.default_rng(4)
    d = days(160)
    vix = {x: float(rng.normal(0, 40)) for x in d[1:]}
    b = bars(spark, price_path(1, d, [0.3 * vix[x] + float(rng.normal(0, 5)) for x in d[1:]]))
    s = series_rows(spark, [("macro:vix_return", x, v, None) for x, v in vix.items()])
    layers = spark.createDataFrame(
        [(1, "sector:NONE", "sector", "S", 1.0, 0), (1, "macro:vix_return", "macro", "M", 1.0, 8)],
        "security_id int, series_key string, driver string, name string, gate double, layer int")
    w = spark.createDataFrame([(1, "daily", d[140], d[141], 0.0)],
                              "security_id int, cadence string, window_start date, window_end date, observed_return_bps double")
    got = hierarchical.layered_rows(w, returns.daily_returns(b), layers, s, 100, CUTOFF).collect()
    assert [r.name for r in got] == ["M"] and got[0].condition_number == 0.0


def test_generated_baskets_share_compositions(spark):
    n = 60
    c = spark.createDataFrame([(i, f"T{i:03d}", "one", "sector", n - i) for i in range(n)],
                              "security_id int, ticker string, industry string, sector string, price_bar_count int")
    chosen = peers.liquid_peers(c)
    assert chosen.count() == n * 20
    weights = chosen.select("target_security_id", F.lit("b").alias("basket_name"), F.lit("v").alias("basket_version"),
                            "peer_security_id", "weight", F.lit(20).cast("long").alias("active_members"))
    assert peers.basket_compositions(weights).select("series_key").distinct().count() == 21


def test_nearest_rank_is_exact(spark):
    rng = random.Random(2)
    values = [round(rng.expovariate(0.2), 6) for _ in range(997)] + [3.25] * 500
    df = spark.createDataFrame([("k", v) for v in values], "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        assert reports.nearest_rank(df, ["k"], "v", q).first().percentile == sorted(values)[round((len(values) - 1) * q)]


def test_moving_the_cutoff_back_never_adds_bars(spark):
    p = Panels(spark, SF)
    now = pit.visible(p.price_raw, "2001-06-01 00:00:00")
    then = pit.visible(p.price_raw, "1999-06-01 00:00:00")
    assert then.count() < now.count()
    assert then.join(now, ["security_id", "event_date", "source"], "left_anti").count() == 0


def test_attribution_is_repeatable_and_resumable(spark):
    p = Panels(spark, SF)
    runs, parts = plan.attribute(market_data(p), settings(), expanded=False)
    again, _ = plan.attribute(market_data(p), settings(), expanded=False)
    key = ["attribution_run_id", "observed_return_bps", "unexplained_residual_bps"]
    assert runs.count() > 0 and runs.select(*key).exceptAll(again.select(*key)).count() == 0
    stored = runs.withColumn("factor_basket_version", F.lit("mvp_expanded_v0")).where("security_id % 2 = 0")
    rest, _ = plan.resume(market_data(p), settings(), stored)
    expected = runs.where("security_id % 2 = 1").count() if runs.where("security_id % 2 = 0").count() else runs.count()
    assert rest.count() == expected


def test_unknown_methodology(spark):
    with pytest.raises(ValueError):
        plan.attribute(market_data(Panels(spark, SF)), settings(methodology="other"))


def test_hot_security_keeps_every_row(spark):
    """A third of all raw rows on one security and day: the dedupe answers the same as without them."""
    base = [(s, d, 100.0 + i, dt.datetime(2026, 1, 1), "a") for s in (1, 2, 3) for i, d in enumerate(days(40))]
    copies = [(1, D(2026, 1, 5), 50.0 + i, dt.datetime(2026, 2, 1) + dt.timedelta(minutes=i), "a") for i in range(600)]
    got = pit.visible_bars(bars(spark, base + copies), CUTOFF)
    assert got.count() == 120
    assert got.where("security_id = 1 AND event_date = '2026-01-05'").first().adjusted_close == 649.0


def test_price_files_stream_once(spark, tmp_path):
    landing, table, state = (str(tmp_path / n) for n in ("landing", "table", "state"))
    (tmp_path / "landing").mkdir()
    bar = lambda day, close: {"date": day, "close": close, "volume": 1}
    (tmp_path / "landing" / "aapl.json").write_text(json.dumps({"historical": [bar("2026-01-02", 10.0), bar("2026-01-05", 11.0)]}))
    for _ in range(2):
        append_prices(landed_prices(spark, landing), table, state, "2026-02-01 00:00:00", "feed").awaitTermination(90)
    (tmp_path / "landing" / "msft.json").write_text(json.dumps([bar("2026-01-02", 20.0)]))
    append_prices(landed_prices(spark, landing), table, state, "2026-02-01 00:00:00", "feed").awaitTermination(90)
    rows = spark.read.parquet(table)
    assert sorted((r.ticker, r.close, r.adjusted_close) for r in rows.collect()) == [
        ("AAPL", 10.0, 10.0), ("AAPL", 11.0, 11.0), ("MSFT", 20.0, 20.0)]


def test_five_factor_confidence_drops_when_collinear(spark):
    rng = np.random.default_rng(9)
    d = days(60)
    x = rng.normal(0, 50, size=(60, 5))
    x[:, 4] = x[:, 3] * 1.001 + rng.normal(0, 0.01, 60)
    rows = [(k, day, float(x[i, j]), None) for i, day in enumerate(d) for j, k in enumerate(["Mkt-RF", "SMB", "HML", "RMW", "CMA"])]
    b = bars(spark, price_path(1, d, [float(v) for v in x[1:, :4] @ [1.2, 0.4, -0.3, 0.2]]))
    w = spark.createDataFrame([(1, "daily", d[50], d[51], 0.0)],
                              "security_id int, cadence string, window_start date, window_end date, observed_return_bps double")
    got = models.five_factor_rows(w, returns.daily_returns(b), series_rows(spark, rows), 60, CUTOFF).collect()
    assert len(got) == 5 and {r.confidence for r in got} == {"Low-Medium"}
    market = [r for r in got if r.driver == "market"][0]
    assert market.beta == pytest.approx(1.2, abs=0.01)

"""The layered model over some securities against a plain window-by-window version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnlens.catalog.core import market_data, settings
from returnlens.catalog.panels import Panels
from returnlens.operators import hierarchical, windows
from returnlens.plans import attribution as plan

SF = "/root/testdata/sf0.01"
FACTORS = ["Mkt-RF", "SMB", "HML", "RMW", "CMA"]
CHOSEN = [1, 3, 6, 11, 14, 20, 22]


def plain_window(own, series, layers, start, end, lookback):
    """(layer, beta, move, observations) of one window. ``own`` and ``series[key]``: day -> (value, day measured against)."""
    low = start - lookback
    inside = lambda table: {d: v for d, (v, e) in table.items() if low <= d <= end and (e is None or e >= low)}
    stock = {d: v for d, v in inside(own).items() if d < start}
    priors = [c for c in (inside(series.get(k, {})) for k in FACTORS) if c]
    out = []
    for slot, key in layers:
        y = inside(series.get(key, {}))
        if not y and slot >= 7:
            continue
        shared = sorted(set(y).intersection(*priors)) if priors else sorted(y)
        fit = [d for d in shared if d < start]
        residual = dict(y)
        if priors and len(fit) > len(priors) + 1:
            design = np.array([[1.0, *[c[d] for c in priors]] for d in fit])
            solution = np.linalg.lstsq(design, np.array([y[d] for d in fit]), rcond=None)[0]
            residual = {d: y[d] - solution[0] - sum(b * c[d] for b, c in zip(solution[1:], priors)) for d in shared}
        priors.append(residual)
        pairs = [(residual[d], stock[d]) for d in residual if d in stock]
        if len(pairs) < hierarchical.MIN_PAIRS:
            continue
        x, r = np.array(pairs).T
        spread = ((x - x.mean()) ** 2).sum()
        beta = 0.0 if spread <= hierarchical.FLAT * (x * x).sum() else ((x - x.mean()) * (r - r.mean())).sum() / spread
        out.append((slot, beta, sum(v for d, v in residual.items() if d > start), len(pairs)))
    return out


@pytest.fixture(scope="module")
def inputs(spark):
    p = Panels(spark, SF)
    data = market_data(p)
    ready = plan.prepare(data, settings(methodology="hierarchical_market_first_v1"))
    return data, ready


def test_every_row_of_some_securities(inputs):
    data, ready = inputs
    cutoff, lookback = settings().cutoff, settings().lookback_days
    compositions, baskets = plan.peer_parts(data, ready.returns, cutoff)
    every = ready.series.unionByName(baskets)
    layers = hierarchical.layer_assignments(data.classes, compositions, data.securities, data.exposures, cutoff)
    some = ready.windows.where(F.col("security_id").isin(CHOSEN) & F.col("cadence").isin("weekly", "monthly"))
    rows = hierarchical.layered_rows(some, ready.returns, layers, every, lookback, cutoff)
    got = {}
    for r in rows.select(*windows.WINDOW, "name", "beta", "factor_move", "observations", "contribution_bps").collect():
        got[(r["security_id"], r["cadence"], r["window_start"], r["name"])] = (r["beta"], r["factor_move"], r["observations"], r["contribution_bps"])
    ordinal = lambda d: d.toordinal() if d else None
    series = {}
    for r in every.collect():
        series.setdefault(r["series_key"], {})[ordinal(r["event_date"])] = (r["value"], ordinal(r["prev_date"]))
    own = {}
    for r in ready.returns.where(F.col("return_bps").isNotNull() & F.col("security_id").isin(CHOSEN)).collect():
        own.setdefault(r["security_id"], {})[ordinal(r["event_date"])] = (r["return_bps"], ordinal(r["prev_date"]))
    held = {}
    for r in layers.where(F.col("security_id").isin(CHOSEN)).collect():
        held.setdefault(r["security_id"], []).append((r["layer"] + 5, r["series_key"], r["name"], r["gate"]))
    want = {}
    for w in some.collect():
        mine = sorted(held[w["security_id"]])
        found = plain_window(own[w["security_id"]], series, [(s, k) for s, k, _, _ in mine], ordinal(w["window_start"]), ordinal(w["window_end"]), lookback)
        by_slot = {s: (n, g) for s, _, n, g in mine}
        for slot, beta, move, n in found:
            name, gate = by_slot[slot]
            if abs(beta * move * gate) <= 100_000:
                want[(w["security_id"], w["cadence"], w["window_start"], name)] = (beta, move, n, beta * move * gate)
    assert len(want) > 100 and set(got) == set(want)
    for key, values in want.items():
        assert np.allclose(got[key], values, rtol=1e-6, atol=1e-6), (key, got[key], values)


def made_panel(seed, gaps=0.02, doubled=False, empty=(), late=()):
    """A panel of 5 market factors and layers 5 to 10 on most days, and one security's own returns."""
    rng = np.random.default_rng(seed)
    days = np.cumsum(rng.integers(1, 4, 420)) + 8000
    values = rng.normal(0, 80, (len(days), 11))
    values[:, 5:] += values[:, :1] * rng.normal(0, 1, 6) + values[:, 5:6] * 0.4
    if doubled:
        values[:, 8] = values[:, 5] * 2 - values[:, 1]  # nothing is left of it after the layers before
        values[:, 9] = 7.0
    for c in range(11):
        values[rng.random(len(days)) < gaps * (c % 3), c] = np.nan
    values[:, list(empty)] = np.nan
    for c in late:
        values[:260, c] = np.nan
    earlier = np.full(values.shape, hierarchical.NEVER)
    for c in range(5, 11):
        at = np.flatnonzero(~np.isnan(values[:, c]))
        earlier[at[1:], c] = days[at[:-1]]
        values[at[:1], c] = np.nan
    own = np.nan_to_num(values[:, :5]) @ rng.normal(0, 1, 5) * (rng.random(len(days)) < 2) + rng.normal(0, 30, len(days))
    own = np.where(rng.random(len(days)) < gaps, np.nan, own)
    own_from = np.full(len(days), hierarchical.NEVER)
    at = np.flatnonzero(~np.isnan(own))
    own_from[at[1:]] = days[at[:-1]]
    own[at[0]] = np.nan
    picks = rng.choice(len(days) - 12, 80, replace=False)
    starts = days[picks]
    ends = days[picks + rng.integers(1, 12, 80)]
    return days, values, earlier, own, own_from, starts, ends


@pytest.mark.parametrize(
    "options",
    [{}, {"gaps": 0.0}, {"gaps": 0.06}, {"doubled": True}, {"empty": (5,)}, {"empty": (7, 9)}, {"empty": (0, 3)}, {"empty": (0, 1, 2, 3, 4)}, {"late": (2, 8)}, {"late": (6,), "gaps": 0.04}],
)
def test_windows_at_once_equal_windows_one_by_one(options):
    for seed in range(3):
        days, values, earlier, own, own_from, starts, ends = made_panel(seed, **options)
        layers, priors, lookback = list(range(5, 11)), list(range(5)), 400
        panel = hierarchical.Panel(days, values, earlier, layers, priors, 7)
        other = (np.where(np.arange(len(days)) % 5 == 0, np.nan, own * 2), own_from, starts[:30], ends[:30])
        first, second = hierarchical.layered_windows(panel, [(own, own_from, starts, ends), other], lookback)
        assert set(second) == set(zip(starts[:30].tolist(), ends[:30].tolist()))
        rows = 0
        for (y, y_from, a, b), found in (((own, own_from, starts, ends), first), (other, second)):
            for start, end in zip(a.tolist(), b.tolist()):
                want = hierarchical.layered_window(days, values, earlier, y, y_from, layers, priors, start, end, lookback, 7)
                got = found[(start, end)]
                assert [(g[0], g[3], g[5]) for g in got] == [(w[0], w[3], w[5]) for w in want]
                finite = [(g, w) for g, w in zip(got, want) if w[4] < 1e6]
                assert np.allclose([g[1:5] for g, _ in finite], [w[1:5] for _, w in finite], rtol=1e-6, atol=1e-6)
                rows += len(want)
        assert rows > 30

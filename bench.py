"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from returnlens.catalog import load
from returnlens.catalog.panels import CUTOFF, Panels
from returnlens.operators import assemble
from returnlens.plans import attribution as plan
from returnlens.session import discard_settled, local_session

HEADLINES = [
    "price_dedupe",
    "daily_returns",
    "attribution_windows",
    "trailing_market_beta",
    "five_factor_betas",
    "market_attribution",
    "five_factor_model",
    "sector_industry_model",
    "peer_basket_model",
    "macro_model",
    "style_descriptors_window",
    "event_evidence",
    "expanded_attribution_runs",
    "hierarchical_attribution",
    "event_taxonomy",
    "exposure_decisions",
    "filing_choice",
    "liquid_peers",
    "promoted_prices",
]
PANELS_USED = [
    "price_raw", "supplier_prices", "factor_return", "security", "macro_series", "classification", "peer_basket",
    "peer_member", "company_exposure", "event", "filings", "supplier_candidates", "price_feed", "ticker_history",
]


def wide_universe(spark, sf_dir):
    """Market attribution of every window of the supplier-level universe."""
    p = Panels(spark, sf_dir)
    securities = p.supplier_candidates.select("security_id")
    data = plan.MarketData(bars=p.supplier_prices, factors=p.factor_return, securities=securities)
    settings = plan.Settings(cutoff=CUTOFF)
    ready = plan.prepare(data, settings)
    rows = plan.market_rows(data, settings, ready)
    return assemble.contributions(ready.windows, rows, CUTOFF, True)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, shuffle_partitions=cpus)
    panels, registry = Panels(spark, sf_dir), load()
    began = time.time()
    for name in PANELS_USED:
        getattr(panels, name)
    times = {"derive_panels": round(time.time() - began, 3)}
    for name in [*HEADLINES, "wide_universe"]:
        build = wide_universe if name == "wide_universe" else registry.QUERIES[name]
        began = time.time()
        build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    discard_settled(spark)
    total = round(sum(v for k, v in times.items() if k != "derive_panels"), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

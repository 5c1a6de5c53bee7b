"""Whole-universe attribution as one plan: data, settings, contributions, runs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.operators import assemble, hierarchical, models, peers, pit, series, windows
from returnlens.operators.returns import daily_returns
from returnlens.session import settle
from returnlens.vocab import CADENCES, METHODOLOGIES


@dataclass(frozen=True)
class MarketData:
    """Raw point-in-time tables; every one may hold several versions of a row."""

    bars: DataFrame
    factors: DataFrame
    securities: DataFrame
    macro: DataFrame | None = None
    classes: DataFrame | None = None
    baskets: DataFrame | None = None
    members: DataFrame | None = None
    exposures: DataFrame | None = None
    events: DataFrame | None = None


@dataclass(frozen=True)
class Settings:
    cutoff: str
    lookback_days: int = 252
    cadences: list[str] = field(default_factory=lambda: list(CADENCES))
    methodology: str = "legacy"
    include_events: bool = True
    require_history: bool = True
    analysis_start: str | None = None


@dataclass(frozen=True)
class Prepared:
    """Visible inputs shared by all models."""

    bars: DataFrame
    returns: DataFrame
    windows: DataFrame
    series: DataFrame


def price_coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("security_id").agg(
        F.min("event_date").alias("first_price_date"),
        F.max("event_date").alias("last_price_date"),
        F.count("*").alias("price_bar_count"),
    )


def select_windows(bars: DataFrame, settings: Settings) -> DataFrame:
    built = windows.with_observed_return(windows.build_windows(bars, settings.cadences))
    if settings.require_history:
        built = windows.with_history(built, price_coverage(bars), settings.lookback_days)
    if settings.analysis_start:
        built = windows.from_analysis_start(built, settings.analysis_start)
    return built


def prepare(data: MarketData, settings: Settings, chosen: DataFrame | None = None) -> Prepared:
    bars = settle(pit.visible_bars(data.bars, settings.cutoff), "bars")
    built = settle(select_windows(bars, settings) if chosen is None else chosen, "windows")
    factors = series.factor_series(pit.visible_factor_returns(data.factors, settings.cutoff))
    if data.macro is not None:
        factors = factors.unionByName(series.macro_factor_series(pit.visible_macro(data.macro, settings.cutoff)))
    return Prepared(bars, settle(daily_returns(bars), "returns"), built, settle(factors, "series"))


def peer_parts(data: MarketData, returns: DataFrame, cutoff: str) -> tuple[DataFrame, DataFrame]:
    """Compositions of every target's active basket and their return series."""
    members = peers.active_members(data.baskets, data.members, cutoff)
    weights = settle(peers.normalised_weights(members, cutoff), "weights")
    compositions = settle(peers.basket_compositions(weights), "compositions")
    return compositions, settle(peers.basket_returns(weights, compositions, returns), "basket-returns")


def market_rows(data: MarketData, settings: Settings, ready: Prepared) -> DataFrame:
    """The small model: market factor only."""
    market = ready.series.where(F.col("series_key") == "Mkt-RF")
    return models.simple_factor_rows(
        ready.windows,
        ready.returns,
        models.market_assignments(data.securities),
        market,
        settings.lookback_days,
        settings.cutoff,
    )


def fitted_rows(data: MarketData, settings: Settings, ready: Prepared) -> DataFrame:
    """All models of the chosen methodology but the events."""
    cutoff, lookback = settings.cutoff, settings.lookback_days
    layered = settings.methodology == "hierarchical_market_first_v1"
    compositions, basket_series = peer_parts(data, ready.returns, cutoff)
    every = ready.series.unionByName(basket_series)
    joint = models.five_factor_rows(
        ready.windows, ready.returns, ready.series, lookback, cutoff, hierarchical.MIN_PAIRS if layered else None
    )
    if layered:
        layers = hierarchical.layer_assignments(data.classes, compositions, data.securities, data.exposures, cutoff)
        factors = hierarchical.layered_rows(ready.windows, ready.returns, layers, every, lookback, cutoff)
    else:
        assigned = (
            models.sector_assignments(data.classes, cutoff)
            .unionByName(models.peer_assignments(compositions))
            .unionByName(models.macro_assignments(data.securities, data.exposures, cutoff))
        )
        factors = models.simple_factor_rows(ready.windows, ready.returns, assigned, every, lookback, cutoff)
    return joint.unionByName(factors).unionByName(models.style_rows(ready.windows, ready.bars, lookback, cutoff))


def with_events(rows: DataFrame, data: MarketData, settings: Settings, ready: Prepared) -> DataFrame:
    """The rows of the models with the event evidence, where it is wanted and there is any."""
    if not settings.include_events or data.events is None:
        return rows
    return rows.unionByName(models.event_rows(ready.windows, data.events, data.securities, settings.cutoff))


def expanded_rows(data: MarketData, settings: Settings, ready: Prepared) -> DataFrame:
    """All models of the chosen methodology."""
    return with_events(fitted_rows(data, settings, ready), data, settings, ready)


def attribute(
    data: MarketData, settings: Settings, chosen: DataFrame | None = None, expanded: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Runs and contributions for every window; ``chosen`` restricts the windows, e.g. to those not stored yet.

    Evidence rows are by far the most and the widest, so they are written once, under their run's id: totals come from the
    windows, times and basis points alone, and the id is formed from the window.
    """
    if settings.methodology not in METHODOLOGIES:
        raise ValueError(f"unsupported attribution methodology {settings.methodology}")
    ready = prepare(data, settings, chosen)
    rows = settle(fitted_rows(data, settings, ready) if expanded else market_rows(data, settings, ready), "inputs")
    if expanded:
        rows = with_events(rows, data, settings, ready)
    cutoff, safe = settings.cutoff, settings.methodology != "legacy"
    totals = settle(assemble.run_totals(ready.windows, assemble.admissible(rows, cutoff)), "totals")
    basket = None if expanded else "french_market_v0"
    parts = assemble.contributions(ready.windows, rows, cutoff, safe, totals=totals)
    run_rows = settle(assemble.runs(ready.windows, parts, cutoff, settings.methodology, basket), "runs")
    parts = assemble.with_run_id(parts, settings.methodology, basket)
    return run_rows, settle(assemble.stored_contributions(run_rows, parts), "contributions")


def resume(data: MarketData, settings: Settings, stored_runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attribute only windows the store does not hold for this methodology."""
    model, basket = METHODOLOGIES[settings.methodology]
    bars = pit.visible_bars(data.bars, settings.cutoff)
    open_windows = windows.not_yet_run(select_windows(bars, settings), stored_runs, model, basket)
    return attribute(data, settings, open_windows)

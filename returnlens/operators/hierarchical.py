"""Layered market-first model: each factor enters only with what earlier layers do not explain.

Layers depend on one another within a window, so this is the one model that runs in Arrow groups. Securities with the same
ordered series form a chain, and whatever does not involve their own returns is worked out once a chain: a group holds the
windows of up to ``SHARED_BY`` securities of one chain that start in one year, with the series those windows reach, each
with at most one row per calendar day.

Inside a group nothing runs window by window. Products of the series are summed up along the days, so the Gram matrix of a
window's lookback is the difference of two running sums: days that enter are added and days that leave are taken off. Each
layer's residual is kept as coefficients over the raw series; the next layer's fit is the same Gram matrix seen through
those coefficients, solved for all windows at once. Windows whose fit is too close to singular for that are fitted row by
row (``layered_window``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from returnlens.functions.scoring import clamp01, confidence_after, factor_penalty, fixed_text, is_usable_bps
from returnlens.operators.exposures import macro_gates
from returnlens.operators.models import contribution_rows, peer_assignments, sector_assignments
from returnlens.operators.series import MACRO_ORDER
from returnlens.session import settle
from returnlens.vocab import COLLINEAR_CONDITION, FIVE_FACTORS

LAYERED_VERSION = "hierarchical-market-first-v1"
MIN_PAIRS = 60
FLAT = 1e-12
#: Securities of one chain in a group, and groups that share one copy of a series when they are laid out.
SHARED_BY = 256

#: Beyond this condition number a window is fitted row by row.
NEAR_SINGULAR = 1e4
NEVER = np.iinfo(np.int64).max

SCHEMA = (
    "security_id {id}, cadence string, window_start date, window_end date, observed_return_bps double, "
    "slot int, beta double, factor_move double, observations long, condition_number double, residualized_against int"
)
FITTED = ["slot", "beta", "factor_move", "observations", "condition_number", "residualized_against"]


def fit_layer(y: np.ndarray, priors: np.ndarray, estimating: np.ndarray) -> tuple[np.ndarray, float, int]:
    """Residual of ``y`` on the prior columns, fitted on estimation rows where all are present.

    With too few common rows the raw series comes back unchanged.
    """
    k = priors.shape[1]
    if k == 0:
        return y, 0.0, 0
    present = ~np.isnan(y) & ~np.isnan(priors).any(axis=1)
    fit = present & estimating
    n = int(fit.sum())
    if n <= k + 1:
        return y, 0.0, 0
    x = priors[fit]
    gram = x.T @ x
    eigen = np.linalg.eigvalsh(gram)
    condition = float(np.sqrt(eigen[-1] / eigen[0])) if eigen[0] > 0 else float("inf")
    if not condition < 1e6:
        condition = float(np.linalg.cond(x))
        design = np.column_stack([np.ones(n), x])
        coefficients = np.linalg.lstsq(design, y[fit], rcond=None)[0]
    else:
        mean_x, mean_y = x.mean(axis=0), y[fit].mean()
        centred = gram - n * np.outer(mean_x, mean_x)
        slopes = np.linalg.lstsq(centred, x.T @ (y[fit] - mean_y), rcond=None)[0]
        coefficients = np.concatenate([[mean_y - mean_x @ slopes], slopes])
    residual = np.full(len(y), np.nan)
    residual[present] = y[present] - coefficients[0] - priors[present] @ coefficients[1:]
    return residual, condition, k


def layered_window(
    days: np.ndarray,
    values: np.ndarray,
    earlier: np.ndarray,
    stock: np.ndarray,
    stock_earlier: np.ndarray,
    layers: list[int],
    prior_columns: list[int],
    start: int,
    end: int,
    lookback: int,
    optional_from: int,
) -> list[tuple]:
    """All layer rows of one window. ``earlier`` is the day each value is measured against.

    Columns from ``optional_from`` on are not layers of a window in which they have no value at all.
    """
    low = start - lookback
    a, b = np.searchsorted(days, low, "left"), np.searchsorted(days, end, "right")
    at = days[a:b]
    block = np.where(earlier[a:b] >= low, values[a:b], np.nan)
    estimating, moving = at < start, at > start
    own = np.where((stock_earlier[a:b] >= low) & estimating, stock[a:b], np.nan)
    columns = [block[:, c] for c in prior_columns if not np.isnan(block[:, c]).all()]
    rows = []
    for column in layers:
        y = block[:, column]
        if column >= optional_from and np.isnan(y).all():
            continue
        priors = np.column_stack(columns) if columns else np.empty((len(at), 0))
        residual, condition, against = fit_layer(y, priors, estimating)
        columns.append(residual)
        paired = ~np.isnan(own) & ~np.isnan(residual)
        n = int(paired.sum())
        if n < MIN_PAIRS:
            continue
        px, py = residual[paired], own[paired]
        spread = float(((px - px.mean()) ** 2).sum())
        flat = spread <= FLAT * float((px * px).sum())
        beta = 0.0 if flat else float(((px - px.mean()) * (py - py.mean())).sum()) / spread
        move = float(np.nansum(residual[moving]))
        rows.append((column, beta, move, n, condition, against))
    return rows


class Panel:
    """The series of one chain on a common axis of days: values, and the day each value is measured against."""

    def __init__(self, days: np.ndarray, values: np.ndarray, earlier: np.ndarray, layers: list[int], priors: list[int], optional_from: int):
        self.days, self.values, self.earlier = days, values, earlier
        self.layers, self.priors, self.optional_from = layers, priors, optional_from
        filled = np.where(np.isnan(values), 0.0, values)
        self.design = np.column_stack([np.ones(len(days)), filled])  # column 0 is the intercept
        self.present = ~np.isnan(values)
        # A value counts where the day it is measured against lies in the window; one that stands alone needs only its own.
        self.from_day = np.where(earlier == NEVER, days[:, None], earlier)

    def visible(self, low: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether each slot has any value in each window."""
        out = np.zeros((len(low), self.values.shape[1]), bool)
        for slot in range(self.values.shape[1]):
            at = np.flatnonzero(self.present[:, slot])
            out[:, slot] = np.searchsorted(self.days[at], end, "right") > np.searchsorted(self.from_day[at, slot], low, "left")
        return out

    def residuals(self, low: np.ndarray, start: np.ndarray, end: np.ndarray):
        """Yields (layer, residual on every day or NaN, condition, number of priors, windows to be fitted row by row).

        Rows are the windows given, which must have values in the same slots (one row of ``visible``).
        """
        has = self.visible(low[:1], end[:1])[0]
        count, width = len(low), self.design.shape[1]
        columns = [s for s in self.priors if has[s]]
        basis = [np.tile(np.eye(width)[s + 1], (count, 1)) for s in columns]
        present = self.present[:, columns].all(axis=1) if columns else np.ones(len(self.days), bool)
        since = self.from_day[:, columns].min(axis=1) if columns else np.full(len(self.days), NEVER)
        for slot in self.layers:
            if slot >= self.optional_from and not has[slot]:
                continue
            raw = np.tile(np.eye(width)[slot + 1], (count, 1))
            alone = self.present[:, slot]
            shared = present & alone
            reach = np.minimum(since, self.from_day[:, slot])
            fitted, condition, bad = self._fit(slot, shared, reach, basis, low, start)
            coefficients = np.where(np.isnan(fitted), raw, fitted)
            fell_back = np.isnan(fitted[:, 0])
            seen = np.where(fell_back[:, None], alone & (self.from_day[:, slot] >= low[:, None]), shared & (reach >= low[:, None]))
            residual = np.where(seen & (self.days <= end[:, None]), coefficients @ self.design.T, np.nan)
            yield slot, residual, condition, np.where(fell_back, 0, len(basis)), bad
            basis.append(coefficients)
            present, since = shared, reach

    def _fit(self, slot, shared, reach, basis, low, start):
        """Coefficients over the intercept and all slots of each window's residual, NaN where there are too few rows."""
        count, width = len(low), self.design.shape[1]
        out, condition, bad = np.full((count, width), np.nan), np.zeros(count), np.zeros(count, bool)
        rows = np.flatnonzero(shared)
        if not basis or not len(rows):
            return out, condition, bad
        z = self.design[rows] * np.concatenate([[True], self._used(basis, slot)])
        running = np.concatenate([np.zeros((1, width, width)), np.cumsum(z[:, :, None] * z[:, None, :], axis=0)])
        enter, leave = np.searchsorted(self.days[rows], start, "left"), np.searchsorted(reach[rows], low, "left")
        able = np.flatnonzero(enter - leave > len(basis) + 1)
        if not len(able):
            return out, condition, bad
        gram = running[enter[able]] - running[leave[able]]
        n = gram[:, 0, 0]
        b = np.stack([c[able] for c in basis], axis=1)  # (windows, priors, raw columns)
        inner = np.einsum("wpq,wqr->wpr", b, gram)
        products = np.einsum("wpr,wsr->wps", inner, b)
        mean, target = inner[:, :, 0] / n[:, None], inner[:, :, slot + 1]
        own_mean = gram[:, 0, slot + 1] / n
        eigen = np.linalg.eigvalsh(products)
        with np.errstate(divide="ignore", invalid="ignore"):
            condition[able] = np.sqrt(eigen[:, -1] / eigen[:, 0])
        centred = products - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
        values, vectors = np.linalg.eigh(centred)
        weak = ~(condition[able] < NEAR_SINGULAR) | ~(values[:, 0] * NEAR_SINGULAR**2 > values[:, -1])
        values = np.where(weak[:, None], 1.0, values)
        right = target - n[:, None] * mean * own_mean[:, None]
        slopes = np.einsum("wpq,wq->wp", vectors, np.einsum("wqp,wq->wp", vectors, right) / values)
        found = -np.einsum("wp,wpq->wq", slopes, b)
        found[:, slot + 1] += 1.0
        found[:, 0] -= own_mean - np.einsum("wp,wp->w", slopes, mean)
        out[able] = found
        bad[able] = weak
        return out, condition, bad

    def _used(self, basis, slot):
        """Slots that the priors' coefficients or the layer touch; the others may hold no value on these rows."""
        used = np.any([np.any(c[:, 1:] != 0, axis=0) for c in basis], axis=0)
        used[slot] = True
        return used


def _pairs(residual: np.ndarray, own: np.ndarray, estimating: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and slope of the own returns on the residual in each window's lookback."""
    paired = estimating & ~np.isnan(residual) & ~np.isnan(own)
    n = paired.sum(axis=1)
    x, y = np.where(paired, residual, 0.0), np.where(paired, own, 0.0)
    some = np.maximum(n, 1)
    dx = np.where(paired, residual - (x.sum(axis=1) / some)[:, None], 0.0)
    dy = np.where(paired, own - (y.sum(axis=1) / some)[:, None], 0.0)
    spread = (dx * dx).sum(axis=1)
    flat = spread <= FLAT * (x * x).sum(axis=1)
    return n, np.where(flat, 0.0, (dx * dy).sum(axis=1) / np.where(flat, 1.0, spread))


def layered_windows(panel: Panel, owners: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], lookback: int) -> list[dict[tuple[int, int], list[tuple]]]:
    """For each owner (own values, days they are measured against, starts, ends) the layer rows of each of its windows."""
    asked = np.unique(np.concatenate([np.column_stack([starts, ends]) for _, _, starts, ends in owners]), axis=0)
    start, end = asked[:, 0], asked[:, 1]
    low = start - lookback
    seen = panel.visible(low, end)
    out: list[dict[tuple[int, int], list[tuple]]] = [{} for _ in owners]
    wanted = [{(int(a), int(b)) for a, b in zip(starts, ends)} for _, _, starts, ends in owners]
    for pattern in np.unique(seen, axis=0):
        at = np.flatnonzero((seen == pattern).all(axis=1))
        for part in np.array_split(at, max(1, -(-len(at) // 512))):
            lows, starts, ends = low[part], start[part], end[part]
            names = [(int(a), int(b)) for a, b in zip(starts, ends)]
            estimating = (panel.days >= lows[:, None]) & (panel.days < starts[:, None])
            moving = (panel.days > starts[:, None]) & (panel.days <= ends[:, None])
            hard, found = np.zeros(len(part), bool), []
            for slot, residual, condition, against, bad in panel.residuals(lows, starts, ends):
                hard |= bad
                move = np.where(moving & ~np.isnan(residual), residual, 0.0).sum(axis=1)
                found.append((slot, residual, move, condition, against))
            for owner, (own, own_from, _, _) in enumerate(owners):
                mine = np.array([k for k, name in enumerate(names) if name in wanted[owner]], np.int64)
                if not len(mine):
                    continue
                shown = np.where((own_from >= lows[mine, None]), own, np.nan)
                for k in mine:
                    out[owner][names[k]] = []
                for slot, residual, move, condition, against in found:
                    n, beta = _pairs(residual[mine], shown, estimating[mine])
                    for k, count, slope in zip(mine.tolist(), n.tolist(), beta.tolist()):
                        if count >= MIN_PAIRS and not hard[k]:
                            out[owner][names[k]].append((slot, slope, float(move[k]), count, float(condition[k]), int(against[k])))
                for k in mine[hard[mine]].tolist():
                    out[owner][names[k]] = layered_window(
                        panel.days, panel.values, panel.earlier, own, own_from, panel.layers, panel.priors, *names[k], lookback, panel.optional_from
                    )
    return out


def layer_assignments(classes: DataFrame, compositions: DataFrame, securities: DataFrame, exposures: DataFrame, cutoff: str) -> DataFrame:
    """Ordered layers of each security: sector, industry, peer basket, then macro factors."""
    sector = sector_assignments(classes, cutoff).select(
        "security_id",
        "series_key",
        "driver",
        F.concat(F.lit("Residualized sector/industry factor ("), "series_key", F.lit(")")).alias("name"),
        "gate",
        F.when(F.col("series_key").startswith("sector:"), 0).otherwise(1).alias("layer"),
    )
    peer = peer_assignments(compositions).select(
        "security_id",
        "series_key",
        "driver",
        F.concat(F.lit("Residualized peer basket ("), "basket_name", F.lit(")")).alias("name"),
        "gate",
        F.lit(2).alias("layer"),
    )
    rank = F.create_map(*[part for i, key in enumerate(MACRO_ORDER) for part in (F.lit(key), F.lit(3 + i))])
    macro = macro_gates(securities, exposures, cutoff).select(
        "security_id",
        "series_key",
        F.lit("macro").alias("driver"),
        F.concat(F.lit("Residualized macro factor ("), "series_key", F.lit(")")).alias("name"),
        clamp01(F.col("gate")).alias("gate"),
        rank[F.col("series_key")].alias("layer"),
    )
    return sector.unionByName(peer).unionByName(macro).where(F.col("gate") > 0)


def layered_rows(
    windows: DataFrame,
    returns: DataFrame,
    layers: DataFrame,
    series: DataFrame,
    lookback_days: int,
    cutoff: str,
) -> DataFrame:
    """Contribution rows of the layered model for all windows."""
    first_layer = len(FIVE_FACTORS)
    securities = windows.select("security_id").distinct()
    market = F.array(
        *[F.struct(F.lit(k).alias("series_key"), F.lit(i).alias("slot")) for i, k in enumerate(FIVE_FACTORS)]
    )
    base = securities.select("security_id", F.inline(market))
    # A peer basket or macro factor without any value is no layer; an assigned sector stays one even when empty.
    observed_keys = series.select("series_key").distinct()
    standing = layers.where(F.col("layer") < 2).unionByName(
        layers.where(F.col("layer") >= 2).join(observed_keys, "series_key", "left_semi").select(*layers.columns)
    )
    slots = base.unionByName(
        standing.select("security_id", "series_key", (F.col("layer") + first_layer).alias("slot"))
    )
    optional_from = first_layer + 2  # peer basket and macro factors
    day = F.unix_date
    lookback = int(lookback_days)
    # Securities with the same ordered series share a chain; a chain of many is cut into blocks. A security has some dozen
    # slots at most, so the list is short.
    chains = slots.groupBy("security_id").agg(F.sort_array(F.collect_set(F.struct("slot", "series_key"))).alias("steps"))
    chains = settle(chains.select("security_id", F.xxhash64("steps").alias("chain"), F.to_json("steps").alias("spelled"), "steps"), "chains")
    sizes = chains.groupBy("chain", "spelled").agg(F.count(F.lit(1)).alias("size"))
    blocks = F.ceil(F.col("size") / SHARED_BY)
    placed = chains.join(sizes, ["chain", "spelled"]).select("security_id", "chain", F.pmod(F.xxhash64("security_id", F.lit(1)), blocks).alias("block"))
    group = ["chain", "block", "start_year"]
    asked = windows.join(placed, "security_id").select(
        "chain", "block", F.year("window_start").alias("start_year"), "security_id", "cadence", "window_start", "window_end", "observed_return_bps"
    )
    stretches = asked.groupBy(*group).agg((day(F.min("window_start")) - lookback).alias("_low"), day(F.max("window_end")).alias("_high"))
    stretches = settle(stretches, "stretches")
    year_of = lambda days: F.year(F.date_from_unix_date(days))
    # Every chain wants the market series, so a series is dealt out by calendar year and, in copies, by a salt of the
    # group: no task lays out more than a year of one series for SHARED_BY groups.
    salts = max(1, -(-stretches.count() // SHARED_BY))
    steps = chains.select("chain", F.explode("steps").alias("step")).select("chain", "step.slot", "step.series_key").distinct()
    held = stretches.join(steps, "chain")
    wanted = held.withColumn("series_year", F.explode(F.sequence(year_of(F.col("_low")), year_of(F.col("_high"))))).withColumn(
        "salt", F.pmod(F.xxhash64(*group), F.lit(salts)).cast("int")
    )
    dealt = series.select(
        "series_key", F.year("event_date").alias("series_year"), day("event_date").alias("day"), "value",
        day("prev_date").alias("earlier"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"),
    )
    kind = windows.schema["security_id"].dataType.simpleString()
    nobody, inside = F.lit(None).cast(kind).alias("owner_id"), F.col("day").between(F.col("_low"), F.col("_high"))
    columns = [*group, "owner_id", "slot", "day", "value", "earlier"]
    observed = wanted.join(dealt, ["series_key", "series_year", "salt"]).where(inside).select(*group, nobody, "slot", "day", "value", "earlier")
    own = (
        returns.where(F.col("return_bps").isNotNull())
        .join(placed, "security_id")
        .select(
            "chain", "block", F.col("security_id").alias("owner_id"), F.lit(-1).alias("slot"), day("event_date").alias("day"),
            F.col("return_bps").alias("value"), day("prev_date").alias("earlier"),
        )
        .join(stretches, ["chain", "block"])
        .where(inside)
        .select(*columns)
    )
    none = F.lit(None).cast("int")
    # One row a slot without a day names the chain's slots, also those without a value here.
    present = held.select(*group, nobody, "slot", none.alias("day"), F.lit(None).cast("double").alias("value"), none.alias("earlier"))
    facts = observed.unionByName(own).unionByName(present)

    def per_chain(ask: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        names = ["security_id", "cadence", "window_start", "window_end", "observed_return_bps", *FITTED]
        seen = facts[facts["day"].notna()]
        if ask.empty or seen.empty:
            return pd.DataFrame(columns=names)
        slots_here = sorted(facts.loc[facts["day"].isna(), "slot"].unique().tolist())
        days = np.unique(seen["day"].to_numpy(dtype=np.int64))
        row = np.searchsorted(days, seen["day"].to_numpy(dtype=np.int64))
        slot, value = seen["slot"].to_numpy(), seen["value"].to_numpy(dtype=float)
        before = seen["earlier"].fillna(np.iinfo(np.int32).max).to_numpy(dtype=np.int64)
        before = np.where(before == np.iinfo(np.int32).max, NEVER, before)
        width = max(max(slots_here), first_layer) + 1
        values, earlier = np.full((len(days), width), np.nan), np.full((len(days), width), NEVER)
        shared = slot >= 0
        values[row[shared], slot[shared]], earlier[row[shared], slot[shared]] = value[shared], before[shared]
        panel = Panel(days, values, earlier, [x for x in slots_here if x >= first_layer], list(range(first_layer)), optional_from)
        epoch = np.datetime64("1970-01-01", "D")
        starts = (pd.to_datetime(ask["window_start"]).to_numpy().astype("datetime64[D]") - epoch).astype(int)
        ends = (pd.to_datetime(ask["window_end"]).to_numpy().astype("datetime64[D]") - epoch).astype(int)
        mine = seen["owner_id"].to_numpy()
        securities = ask["security_id"].unique()
        owners, rows_of = [], []
        for security in securities:
            own, own_from = np.full(len(days), np.nan), np.full(len(days), NEVER)
            k = ~shared & (mine == security)
            own[row[k]], own_from[row[k]] = value[k], before[k]
            at = np.flatnonzero((ask["security_id"] == security).to_numpy())
            owners.append((own, own_from, starts[at], ends[at]))
            rows_of.append(at)
        picked, out = [], []
        for found, at in zip(layered_windows(panel, owners, lookback), rows_of):
            for i in at.tolist():
                fits = found[(int(starts[i]), int(ends[i]))]
                picked += [i] * len(fits)
                out += fits
        return pd.concat([ask.iloc[picked].reset_index(drop=True), pd.DataFrame(out, columns=FITTED)], axis=1)[names]

    # The groups are small in bytes and heavy in arithmetic, so their number of tasks must not shrink with their size.
    tasks = int(windows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fits = (
        asked.repartition(tasks, *group)
        .groupBy(*group)
        .cogroup(facts.repartition(tasks, *group).groupBy(*group))
        .applyInPandas(per_chain, SCHEMA.format(id=kind))
    )
    named = fits.join(
        layers.select("security_id", (F.col("layer") + first_layer).alias("slot"), "series_key", "driver", "name", "gate"),
        ["security_id", "slot"],
    )
    bps = F.col("beta") * F.col("factor_move") * F.col("gate")
    usable = named.where(is_usable_bps(bps))
    condition, n = F.col("condition_number"), F.col("observations")
    confidence = F.when(condition > COLLINEAR_CONDITION, "Low-Medium").otherwise(
        confidence_after(factor_penalty(n, MIN_PAIRS))
    )
    layers_before = F.transform(
        F.when(F.col("residualized_against") > 0, F.sequence(F.lit(0), F.col("residualized_against") - 1)).otherwise(
            F.array().cast("array<int>")
        ),
        lambda i: F.concat(F.lit("prior_layer_"), i.cast("string")),
    )
    factor = F.when(F.col("driver") == "peer", F.regexp_replace("name", r"^Residualized peer basket \((.*)\)$", "peer:$1")).otherwise(
        F.col("series_key")
    )
    return contribution_rows(
        usable,
        cutoff,
        driver=F.col("driver"),
        name=F.col("name"),
        contribution_bps=bps,
        confidence=confidence,
        beta=F.col("beta"),
        factor_move=F.col("factor_move"),
        observations=n,
        condition_number=condition,
        evidence=F.array(
            F.concat(F.lit("beta="), fixed_text(F.col("beta"), 4)),
            F.concat(F.lit("residualized_factor_return_bps="), fixed_text(F.col("factor_move"), 4)),
            F.format_string("observations=%d", n),
            F.format_string("condition_number=%.4f", condition),
            F.lit(f"model={LAYERED_VERSION}"),
        ),
        evidence_payload=F.to_json(
            F.struct(
                factor.alias("factor_name"),
                factor.alias("raw_factor_name"),
                layers_before.alias("residualized_against"),
                F.lit(LAYERED_VERSION).alias("hierarchy_version"),
                "beta",
                F.col("factor_move").alias("factor_move_bps"),
                "observations",
                "condition_number",
                F.col("gate").alias("exposure_gate"),
                F.lit(LAYERED_VERSION).alias("model_version"),
            )
        ),
    )

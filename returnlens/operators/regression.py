"""Regressions over each security's trailing lookback.

A range join of windows to observations would emit (windows x lookback) rows. Instead every observation carries
running sums, and the sums that have left the lookback are found by merging boundary probes into the same ordering:
two sorts over rows already grouped by security, linear in the number of bars.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGINNING = "0001-01-01"
FLAT = 1e-12


def trailing_sums(
    rows: DataFrame,
    keys: list[str],
    terms: dict[str, Column],
    counted: Column,
    usable_from: Column,
    lookback_days: int,
) -> DataFrame:
    """For every row's day ``d``: sums of ``terms`` over counted rows in ``[d - lookback, d)``.

    A row only counts for a lookback that also contains its ``usable_from`` day (the earlier observation its value
    is measured against); null means that day does not exist and the row never counts.
    """
    names = list(terms)
    w = Window.partitionBy(*keys).orderBy("event_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = rows.select(
        *keys,
        "event_date",
        counted.alias("_counted"),
        usable_from.alias("_usable"),
        *[F.coalesce(F.when(counted, t), F.lit(0.0)).alias(f"_{n}") for n, t in terms.items()],
    )
    summed = held.select(
        *keys,
        "event_date",
        "_counted",
        "_usable",
        F.struct(*[F.sum(f"_{n}").over(w).alias(n) for n in names]).alias("_through"),
        F.struct(*[F.col(f"_{n}").alias(n) for n in names]).alias("_own"),
    )
    before = F.struct(*[(F.col(f"_through.{n}") - F.col(f"_own.{n}")).alias(n) for n in names])
    bound = F.date_sub("event_date", lookback_days)
    empty_start = F.col("_counted") & (F.coalesce("_usable", F.lit(BEGINNING).cast("date")) < bound)
    day = F.lit(None).cast("date")
    leaves = F.struct(
        F.coalesce("_usable", F.lit(BEGINNING).cast("date")).alias("at"),
        F.lit(1).alias("kind"),
        day.alias("start"),
        F.lit(False).alias("empty"),
        F.col("_through").alias("sums"),
    )
    probe = F.struct(
        bound.alias("at"),
        F.lit(0).alias("kind"),
        F.col("event_date").alias("start"),
        empty_start.alias("empty"),
        before.alias("sums"),
    )
    timeline = summed.select(
        *keys, F.explode(F.when(F.col("_counted"), F.array(leaves, probe)).otherwise(F.array(probe))).alias("_e")
    ).select(*keys, "_e.*")
    order = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.last(F.when(F.col("kind") == 1, F.col("sums")), ignorenulls=True).over(order)
    probes = timeline.withColumn("_left", left).where(F.col("kind") == 0)
    kept = [
        F.when(F.col("empty"), F.lit(0.0))
        .otherwise(F.col(f"sums.{n}") - F.coalesce(F.col(f"_left.{n}"), F.lit(0.0)))
        .alias(n)
        for n in names
    ]
    return probes.select(*keys, F.col("start").alias("event_date"), *kept)


def slope(n: Column, sx: Column, sy: Column, sxy: Column, sxx: Column) -> Column:
    """Least-squares slope from sums; a flat regressor gives 0 rather than null."""
    spread = sxx - F.try_divide(sx * sx, n)
    together = sxy - F.try_divide(sx * sy, n)
    return F.when(spread <= F.lit(FLAT) * sxx, F.lit(0.0)).otherwise(F.try_divide(together, spread))


def pair_terms(y: Column, x: Column) -> dict[str, Column]:
    return {"n": F.lit(1.0), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x}


def trailing_betas(
    returns: DataFrame, assigned: DataFrame, series: DataFrame, lookback_days: int
) -> DataFrame:
    """Simple beta of each security on each series assigned to it, for every day a window may start on."""
    grid = returns.join(assigned, "security_id")
    valued = grid.join(
        series.select("series_key", "event_date", F.col("value").alias("x"), F.col("prev_date").alias("x_prev")),
        ["series_key", "event_date"],
        "left",
    )
    y, x = F.col("return_bps"), F.col("x")
    counted = y.isNotNull() & x.isNotNull()
    usable = F.least("prev_date", F.coalesce("x_prev", "prev_date"))
    sums = trailing_sums(
        valued, ["security_id", "series_key"], pair_terms(y, x), counted, usable, lookback_days
    )
    beta = slope(*[F.col(c) for c in ("n", "sx", "sy", "sxy", "sxx")])
    return sums.where("n >= 2").select(
        "security_id",
        "series_key",
        F.col("event_date").alias("window_start"),
        F.col("n").cast("long").alias("observations"),
        beta.alias("beta"),
    )


def moment_names(k: int) -> list[tuple[int, int]]:
    """Upper triangle of the cross-product matrix of (1, x1..xk, y)."""
    return [(i, j) for i in range(k + 2) for j in range(i, k + 2) if (i, j) != (k + 1, k + 1)]


def trailing_moments(
    returns: DataFrame, wide: DataFrame, factor_columns: list[str], lookback_days: int
) -> DataFrame:
    """Cross products of an intercept, k factors and the return over each trailing lookback."""
    k = len(factor_columns)
    rows = returns.join(wide, "event_date", "left")
    values = [F.lit(1.0), *[F.col(c) for c in factor_columns], F.col("return_bps")]
    counted = F.col("return_bps").isNotNull()
    for c in factor_columns:
        counted = counted & F.col(c).isNotNull()
    terms = {f"m_{i}_{j}": values[i] * values[j] for i, j in moment_names(k)}
    sums = trailing_sums(rows, ["security_id"], terms, counted, F.col("prev_date"), lookback_days)
    return sums.select(
        "security_id",
        F.col("event_date").alias("window_start"),
        F.col("m_0_0").cast("long").alias("observations"),
        F.array(*[F.col(f"m_{i}_{j}") for i, j in moment_names(k)]).alias("moments"),
    )


def solve_moments(stacked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Slopes and uncentred condition number for a batch of packed cross-product matrices."""
    full = np.zeros((len(stacked), k + 2, k + 2))
    for at, (i, j) in enumerate(moment_names(k)):
        full[:, i, j] = full[:, j, i] = stacked[:, at]
    design, target = full[:, : k + 1, : k + 1], full[:, : k + 1, k + 1]
    eigen = np.linalg.eigvalsh(full[:, 1 : k + 1, 1 : k + 1])
    low, high = np.maximum(eigen[:, 0], 0.0), eigen[:, -1]
    with np.errstate(divide="ignore", invalid="ignore"):
        condition = np.where(low > 0, np.sqrt(high / low), np.inf)
    coefficients = np.zeros((len(stacked), k + 1))
    well = condition < 1e6
    try:
        coefficients[well] = np.linalg.solve(design[well], target[well][..., None])[..., 0]
    except np.linalg.LinAlgError:
        well = np.zeros(len(stacked), dtype=bool)
    if (~well).any():
        inverse = np.linalg.pinv(design[~well], rcond=1e-12, hermitian=True)
        coefficients[~well] = (inverse @ target[~well][..., None])[..., 0]
    return coefficients[:, 1:], condition


def multi_betas(moments: DataFrame, k: int, min_observations: int) -> DataFrame:
    """Multivariate betas and condition number, solved in Arrow batches of small matrices."""

    @F.pandas_udf("struct<betas: array<double>, condition_number: double>")
    def solve(packed: pd.Series) -> pd.DataFrame:
        if packed.empty:
            return pd.DataFrame({"betas": [], "condition_number": []})
        betas, condition = solve_moments(np.vstack(packed.to_numpy()), k)
        return pd.DataFrame({"betas": list(betas), "condition_number": condition})

    enough = moments.where(F.col("observations") >= min_observations)
    return enough.withColumn("_fit", solve("moments")).select(
        "security_id", "window_start", "observations", "_fit.betas", "_fit.condition_number"
    )


def literal_betas(windows: DataFrame, pairs: DataFrame, lookback_days: int) -> DataFrame:
    """The same simple beta by a literal range join; a cross-check for small data."""
    w, p = windows.alias("w"), pairs.alias("p")
    bound = F.date_sub("w.window_start", lookback_days)
    inside = w.join(
        p,
        (F.col("w.security_id") == F.col("p.security_id"))
        & (F.col("p.event_date") < F.col("w.window_start"))
        & (F.col("p.event_date") >= bound)
        & (F.col("p.prev_date") >= bound),
    )
    return inside.groupBy("w.security_id", "w.window_start").agg(
        F.count("*").alias("observations"),
        F.coalesce(F.regr_slope("p.return_bps", "p.x"), F.lit(0.0)).alias("beta"),
    )

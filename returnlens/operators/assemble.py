"""From contribution rows to reconciled runs: residual, shares, diagnostics, confidence and narrative."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.identity import name_uuid
from returnlens.functions.scoring import fixed_text, plain_share, residual_confidence, safe_share, share_denominator, share_is_stable
from returnlens.operators.pit import top_rows, visible
from returnlens.vocab import (
    DRIVER_RANK,
    METHODOLOGIES,
    PRODUCTION,
    RESIDUAL_DRIVER,
    RESIDUAL_NAME,
    RUN_KEY,
    SHARE_THRESHOLD_BPS,
)

RUN_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "returnlens:attribution-run")
DATA_VERSION = "local-dev"


def driver_rank(driver: Column) -> Column:
    return F.create_map(*[F.lit(p) for pair in DRIVER_RANK.items() for p in pair])[driver]


def admissible(rows: DataFrame, cutoff: str) -> DataFrame:
    """Inputs that fall inside their window, are visible and are not residuals themselves."""
    start, end = F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz")
    return visible(rows, cutoff).where(
        (F.col("event_time") >= start) & (F.col("event_time") <= end) & (F.col("driver") != RESIDUAL_DRIVER)
    )


def run_totals(windows: DataFrame, rows: DataFrame, threshold: float = SHARE_THRESHOLD_BPS) -> DataFrame:
    """Explained and gross sums per window with the residual and share diagnostics; windows without rows included."""
    sums = rows.groupBy(*RUN_KEY).agg(
        F.sum("contribution_bps").alias("explained_bps"),
        F.sum(F.abs("contribution_bps")).alias("gross_bps"),
    )
    zero = F.lit(0.0)
    seen = windows.select(*RUN_KEY, "observed_return_bps").join(sums, RUN_KEY, "left")
    observed = F.col("observed_return_bps")
    explained = F.coalesce("explained_bps", zero)
    denominator = share_denominator(observed, threshold)
    residual = observed - explained
    stable = share_is_stable(observed, threshold)
    return seen.select(
        *RUN_KEY,
        "observed_return_bps",
        residual.alias("unexplained_residual_bps"),
        denominator.alias("denominator_bps"),
        stable.alias("share_is_stable"),
        (F.coalesce("gross_bps", zero) / denominator).alias("gross_contribution_leverage"),
        (F.abs(explained) / denominator).alias("net_explained_leverage"),
        (F.abs(residual) / denominator).alias("residual_leverage"),
        F.when(stable, "stable").otherwise("unstable_small_observed_move").alias("share_display_status"),
    )


def _diagnostics_json(threshold: float) -> Column:
    return F.to_json(
        F.struct(
            F.col("observed_return_bps").alias("share_denominator_bps"),
            "share_is_stable",
            F.lit(float(threshold)).alias("share_stability_threshold_bps"),
            "gross_contribution_leverage",
            "net_explained_leverage",
            "residual_leverage",
            "share_display_status",
        )
    )


def _merged_json(first: Column, second: Column) -> Column:
    opened = F.substr(first, F.lit(1), F.length(first) - 1)
    joined = F.concat(opened, F.lit(","), F.substr(second, F.lit(2)))
    return F.when(first == "{}", second).otherwise(joined)


def contributions(
    windows: DataFrame,
    rows: DataFrame,
    cutoff: str,
    safe_shares: bool,
    threshold: float = SHARE_THRESHOLD_BPS,
    totals: DataFrame | None = None,
) -> DataFrame:
    """Every contribution of every window plus exactly one residual row, with shares under the chosen policy.

    ``totals`` are the ``run_totals`` of the admissible rows, if they are at hand.
    """
    inputs = admissible(rows, cutoff)
    totals = run_totals(windows, inputs, threshold) if totals is None else totals
    observed, bps = F.col("observed_return_bps"), F.col("contribution_bps")
    share = safe_share(bps, observed, threshold) if safe_shares else plain_share(bps, observed)
    diagnosed = totals.withColumn("_diagnostics", _diagnostics_json(threshold))
    factors = inputs
    if safe_shares:
        factors = inputs.join(diagnosed.select(*RUN_KEY, "_diagnostics"), RUN_KEY).withColumn(
            "evidence_payload", _merged_json(F.col("evidence_payload"), F.col("_diagnostics"))
        )
    residual = F.col("unexplained_residual_bps")
    denominator = F.col("denominator_bps") if safe_shares else F.abs(observed)
    rest = diagnosed.select(
        *RUN_KEY,
        "observed_return_bps",
        F.lit(RESIDUAL_DRIVER).alias("driver"),
        F.lit(RESIDUAL_NAME).alias("name"),
        residual.alias("contribution_bps"),
        residual_confidence(residual, denominator).alias("confidence"),
        F.lit(PRODUCTION).alias("contribution_stage"),
        F.array().cast("array<string>").alias("evidence"),
        (F.col("_diagnostics") if safe_shares else F.lit("{}")).alias("evidence_payload"),
    )
    both = factors.select(*rest.columns).unionByName(rest)
    return both.withColumn("share_of_move", share)


def run_id(*parts: Column) -> Column:
    return name_uuid(RUN_NAMESPACE, F.concat_ws("|", *[p.cast("string") for p in parts]))


def _id_of_window(methodology: str, basket_version: str | None) -> Column:
    model, basket = METHODOLOGIES[methodology]
    return run_id(*[F.col(c) for c in RUN_KEY], F.lit(model), F.lit(basket_version or basket))


def with_run_id(parts: DataFrame, methodology: str, basket_version: str | None = None) -> DataFrame:
    """Contributions of windows with the id ``runs`` gives their run."""
    return parts.withColumn("attribution_run_id", _id_of_window(methodology, basket_version))


def runs(windows: DataFrame, parts: DataFrame, cutoff: str, methodology: str, basket_version: str | None = None) -> DataFrame:
    """One run per window with a deterministic id; bps are kept to six decimals."""
    model, basket = METHODOLOGIES[methodology]
    basket = basket_version or basket
    residual = parts.where(F.col("driver") == RESIDUAL_DRIVER).select(
        *RUN_KEY, F.col("contribution_bps").alias("unexplained_residual_bps")
    )
    return (
        windows.select(*RUN_KEY, "observed_return_bps")
        .join(residual, RUN_KEY)
        .select(
            _id_of_window(methodology, basket).alias("attribution_run_id"),
            *RUN_KEY,
            F.lit(cutoff).cast("timestamp_ntz").alias("attribution_cutoff"),
            F.round("observed_return_bps", 6).alias("observed_return_bps"),
            F.round("unexplained_residual_bps", 6).alias("unexplained_residual_bps"),
            F.lit(model).alias("model_version"),
            F.lit(DATA_VERSION).alias("data_version"),
            F.lit(basket).alias("factor_basket_version"),
            F.lit(cutoff).cast("timestamp_ntz").alias("created_at"),
        )
    )


def stored_contributions(run_rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Contributions keyed by run id; bps to six decimals, shares to eight.

    Rows that carry their run's id already need no lookup by window.
    """
    keyed = parts
    if "attribution_run_id" not in parts.columns:
        keyed = parts.join(run_rows.select("attribution_run_id", *RUN_KEY), RUN_KEY)
    return keyed.select(
        "attribution_run_id",
        "driver",
        "name",
        F.round("contribution_bps", 6).alias("contribution_bps"),
        F.round("share_of_move", 8).alias("share_of_move"),
        "confidence",
        "evidence",
        "contribution_stage",
        "evidence_payload",
    )


def _one_decimal(value: Column) -> Column:
    return fixed_text(value, 1)


def narratives(run_rows: DataFrame, parts: DataFrame, threshold: float = SHARE_THRESHOLD_BPS) -> DataFrame:
    """Up to four sentences per run, built only from stored numbers."""
    key = "attribution_run_id"
    moving = parts.where((F.col("driver") != RESIDUAL_DRIVER) & (F.abs("contribution_bps") > 0))
    size = F.abs("contribution_bps").desc()
    top = top_rows(moving, [key], [size, driver_rank(F.col("driver")).asc(), F.col("name").asc()], 3)
    listed = top.groupBy(key).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    (-F.abs("contribution_bps")).alias("size"),
                    driver_rank(F.col("driver")).alias("rank"),
                    F.col("name").alias("name"),
                    F.col("contribution_bps").alias("bps"),
                )
            )
        ).alias("top")
    )
    events = parts.where(F.col("driver") == "event").groupBy(key).agg(F.count("*").alias("events"))
    described = F.transform(
        "top", lambda t: F.concat(t["name"], F.lit(" ("), _one_decimal(t["bps"]), F.lit(" bps)"))
    )
    observed, residual = F.col("observed_return_bps"), F.col("unexplained_residual_bps")
    stable = share_is_stable(observed, threshold)
    large = F.try_divide(F.abs(residual), F.abs(observed)) > 0.5
    # Fixed text: the sentences of a narrative.
    sentences = F.concat_ws(
        " ",
        F.concat(F.lit("Observed move was "), _one_decimal(observed), F.lit(" bps over the selected window.")),
        F.when(
            F.col("top").isNotNull(),
            F.concat(F.lit("Largest modeled drivers were "), F.array_join(described, ", "), F.lit(".")),
        ).otherwise("No production factor rows were available, so the move remains residual-driven."),
        F.when(
            stable,
            F.concat(
                F.lit("Unexplained residual was "),
                _one_decimal(residual),
                F.lit(" bps, which is "),
                F.when(large, "large").otherwise("contained"),
                F.lit(" relative to the move."),
            ),
        ).otherwise(
            F.concat(
                F.lit("Unexplained residual was "),
                _one_decimal(residual),
                F.lit(" bps; share percentages are unstable for this small observed move."),
            )
        ),
        F.when(
            F.col("events") > 0,
            F.concat(
                F.col("events").cast("string"),
                F.lit(" visible event evidence row(s) were attached but not assigned causal contribution."),
            ),
        ),
    )
    return (
        run_rows.join(listed, key, "left")
        .join(events, key, "left")
        .select(*run_rows.columns, sentences.alias("narrative"))
    )

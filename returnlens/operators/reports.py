"""Read-side results: charts, driver tables, methodology metrics and progress."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnlens.functions.scoring import display_share, share_denominator, share_is_stable
from returnlens.operators.pit import top_rows
from returnlens.session import settle
from returnlens.vocab import CHART_DRIVERS, RESIDUAL_DRIVER, SHARE_THRESHOLD_BPS

# Days back from the last price of each chart range.
RANGE_DAYS = {
    "10d": 10,
    "1m": 31,
    "3m": 92,
    "6m": 183,
    "1y": 366,
}
# Ranges drawn from weekly runs.
WEEKLY_RANGES = ["6m", "1y", "max"]
NEAR_ZERO_PCT = 0.000001


def run_details(runs: DataFrame, parts: DataFrame, threshold: float = SHARE_THRESHOLD_BPS) -> DataFrame:
    """Runs with their contributions, one row per contribution, small-move shares hidden.

    A run without contributions keeps one row. Such runs are looked up by id alone, so that the contributions, by far the
    wider side, meet the runs in a plain join and need not be moved where the runs are few.
    """
    shown = display_share(F.col("share_of_move"), F.col("observed_return_bps"), threshold)
    held = runs.join(parts, "attribution_run_id")
    bare = runs.join(parts.select("attribution_run_id").distinct(), "attribution_run_id", "left_anti")
    return held.unionByName(bare, allowMissingColumns=True).withColumn("share_of_move", shown)


def run_history(runs: DataFrame, limit: int = 50, cadence: str | None = None) -> DataFrame:
    chosen = runs if cadence is None else runs.where(F.col("cadence") == cadence)
    return chosen.orderBy(F.col("window_end").desc(), F.col("created_at").desc(), F.col("attribution_run_id")).limit(limit)


def chart_bounds(bars: DataFrame, chart_range: str) -> DataFrame:
    """Per security: the chart's end is its last price, the start lies the range before it."""
    spans = bars.groupBy("security_id").agg(
        F.min("event_date").alias("first_date"), F.max("event_date").alias("chart_end")
    )
    start = F.col("first_date") if chart_range == "max" else F.date_sub("chart_end", RANGE_DAYS[chart_range])
    return spans.select("security_id", start.alias("chart_start"), "chart_end")


def chart_prices(bars: DataFrame, bounds: DataFrame) -> DataFrame:
    """Newest bar per day inside each chart with the percent move since its first bar."""
    shown = bars.join(bounds, "security_id").where(F.col("event_date").between(F.col("chart_start"), F.col("chart_end")))
    inside = top_rows(shown, ["security_id", "event_date"], [F.col("timestamp_available").desc(), F.col("source").asc()])
    first = F.first("adjusted_close").over(Window.partitionBy("security_id").orderBy("event_date"))
    return inside.select(
        "security_id",
        "event_date",
        "adjusted_close",
        ((F.col("adjusted_close") / first - 1.0) * 100).alias("cumulative_return_pct"),
        (F.col("adjusted_close") - first).alias("price_change_usd"),
    )


def chart_points(runs: DataFrame, parts: DataFrame, bounds: DataFrame, chart_range: str) -> DataFrame:
    """Contributions in percent of the runs a chart shows; these are few, and written first so that the planner knows."""
    cadence = "weekly" if chart_range in WEEKLY_RANGES else "daily"
    chosen = (
        runs.where(F.col("cadence") == cadence)
        .join(bounds, "security_id")
        .where(F.col("window_end").between(F.col("chart_start"), F.col("chart_end")))
    )
    return run_details(settle(chosen, "charted"), parts).select(
        "security_id",
        "attribution_run_id",
        F.col("window_end").alias("event_date"),
        "window_start",
        (F.col("observed_return_bps") / 100).alias("observed_return_pct"),
        "driver",
        "name",
        (F.col("contribution_bps") / 100).alias("contribution_pct"),
        "share_of_move",
    )


def chart_rank(driver: Column) -> Column:
    known = F.array(*[F.lit(d) for d in CHART_DRIVERS])
    return F.array_position(known, driver)


def driver_order(points: DataFrame, keys: list[str]) -> DataFrame:
    """Drivers present per chart: the known ones in their order, then the rest by name."""
    present = points.select(*keys, "driver").distinct()
    place = chart_rank(F.col("driver"))
    order = Window.partitionBy(*keys).orderBy(place == 0, place, "driver")
    return present.withColumn("position", F.row_number().over(order))


def period_sums(points: DataFrame) -> DataFrame:
    return points.groupBy("security_id", "event_date", "driver").agg(F.sum("contribution_pct").alias("period_pct"))


def stacked_bands(points: DataFrame, prices: DataFrame) -> DataFrame:
    """Cumulative contribution per driver on every price day, stacked above and below zero in driver order.

    The running sum adds only sums that fall on price days. Each security has a fixed set of drivers and one row per
    price day, so the windows stay small.
    """
    sums = period_sums(points)
    order = driver_order(points, ["security_id"])
    spine = prices.select("security_id", "event_date", "cumulative_return_pct").join(order, "security_id")
    filled = spine.join(sums, ["security_id", "event_date", "driver"], "left")
    along = Window.partitionBy("security_id", "driver").orderBy("event_date").rowsBetween(Window.unboundedPreceding, 0)
    net = F.sum(F.coalesce("period_pct", F.lit(0.0))).over(along)
    up = F.when(F.col("net_pct") > NEAR_ZERO_PCT, F.col("net_pct")).otherwise(0.0)
    down = F.when(F.col("net_pct") < -NEAR_ZERO_PCT, F.col("net_pct")).otherwise(0.0)
    day = Window.partitionBy("security_id", "event_date").orderBy("position")
    through = day.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("security_id", "event_date")
    border = F.when(F.col("cumulative_return_pct") >= 0, F.sum(down).over(whole)).otherwise(F.sum(up).over(whole))
    return filled.withColumn("net_pct", net).select(
        "security_id",
        "event_date",
        "driver",
        "position",
        "net_pct",
        (F.sum(up).over(through) - up).alias("positive_from"),
        F.sum(up).over(through).alias("positive_to"),
        F.sum(down).over(through).alias("negative_from"),
        (F.sum(down).over(through) - down).alias("negative_to"),
        F.when(F.abs(border) > NEAR_ZERO_PCT, border).alias("opposite_border_pct"),
    )


def average_shares(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean share of move per driver and name; hidden shares do not count."""
    return (
        points.where(F.col("share_of_move").isNotNull())
        .groupBy(*keys, "driver", "name")
        .agg(F.avg("share_of_move").alias("average_share_of_move"))
    )


def selection_summary(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Percent price change between the first and last selected day; needs two points."""
    low, high = sorted([start, end])
    chosen = prices.where(F.col("event_date").between(F.lit(low).cast("date"), F.lit(high).cast("date")))
    ends = chosen.groupBy("security_id").agg(
        F.min("event_date").alias("selected_from"),
        F.max("event_date").alias("selected_to"),
        F.min_by("adjusted_close", "event_date").alias("first_close"),
        F.max_by("adjusted_close", "event_date").alias("last_close"),
        F.count("*").alias("points"),
    )
    return ends.where("points >= 2").select(
        "security_id",
        "selected_from",
        "selected_to",
        ((F.col("last_close") / F.col("first_close") - 1) * 100).alias("price_change_pct"),
    )


def driver_table(parts: DataFrame, driver: str | None = None, descending: bool = True) -> DataFrame:
    rows = parts if driver in (None, "all") else parts.where(F.col("driver") == driver)
    by = F.col("contribution_bps")
    return rows.orderBy(by.desc() if descending else by.asc(), "name")


def export_rows(runs: DataFrame, parts: DataFrame) -> DataFrame:
    """Driver-table export: every cell as text, hidden shares blank, nested values as JSON."""
    detail = run_details(runs, parts)
    return detail.select(
        "attribution_run_id",
        "driver",
        "name",
        F.col("contribution_bps").cast("string").alias("contribution_bps"),
        F.coalesce(F.col("share_of_move").cast("string"), F.lit("")).alias("share_of_move"),
        "confidence",
        F.col("contribution_stage").alias("stage"),
        F.to_json("evidence").alias("evidence"),
        "evidence_payload",
    )


def write_export(rows: DataFrame, path: str, compression: str = "none") -> None:
    """Quoted CSV; written as text, evidence takes more than ten times its space in the store, ``gzip`` about as much."""
    table = rows.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"')
    table.option("compression", compression).csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def _narrowed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """The rows of the bucket that holds the wanted rank, with the count before it.

    ``rows`` carry ``_v``, the bounds ``_low`` and ``_width`` of their buckets, ``_before`` and ``_rank``. A group has at
    most ``buckets`` buckets however many values it has.
    """
    place = F.when(F.col("_width") > 0, F.floor((F.col("_v") - F.col("_low")) / F.col("_width"))).otherwise(0)
    placed = rows.withColumn("_bucket", F.greatest(F.lit(0), F.least(place, F.lit(buckets - 1))))
    sums = placed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_in"), F.first("_before").alias("_start"), F.first("_rank").alias("_wanted"))
    through = F.sum("_in").over(Window.partitionBy(*keys).orderBy("_bucket")) + F.col("_start")
    holding = (
        sums.withColumn("_through", through)
        .where((F.col("_through") - F.col("_in") <= F.col("_wanted")) & (F.col("_wanted") < F.col("_through")))
        .select(*keys, "_bucket", (F.col("_through") - F.col("_in")).alias("_passed"))
    )
    low = F.col("_low") + F.col("_bucket") * F.col("_width")
    return placed.join(holding, [*keys, "_bucket"]).select(
        *keys, "_v", low.alias("_low"), (F.col("_width") / buckets).alias("_width"), F.col("_passed").alias("_before"), "_rank"
    )


def nearest_rank(rows: DataFrame, keys: list[str], value: str, q: float, buckets: int = 4096) -> DataFrame:
    """Exact nearest-rank percentile (ties of the rank go to even) without ordering a whole group in one task.

    Each group's range is cut into ``buckets`` equal buckets, the one holding the rank is found by counting and cut again,
    and only the distinct values of that fine bucket are ordered.
    """
    given = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    spans = given.groupBy(*keys).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    ranks = spans.select(
        *keys, "_low", ((F.col("_high") - F.col("_low")) / buckets).alias("_width"), F.lit(0).cast("long").alias("_before"),
        F.bround((F.col("_n") - 1) * F.lit(q), 0).alias("_rank"),
    )
    near = _narrowed(_narrowed(given.join(ranks, keys), keys, buckets), keys, buckets)
    counts = near.groupBy(*keys, "_v").agg(F.count("*").alias("_n"), F.first("_before").alias("_start"), F.first("_rank").alias("_wanted"))
    through = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v")) + F.col("_start")
    reached = counts.withColumn("_through", through).where(F.col("_through") > F.col("_wanted"))
    return reached.groupBy(*keys).agg(F.min("_v").alias("percentile"))


def methodology_metrics(runs: DataFrame, parts: DataFrame, threshold: float = SHARE_THRESHOLD_BPS) -> DataFrame:
    """Residual size, leverage and coverage per model version."""
    gross = parts.where(F.col("driver") != RESIDUAL_DRIVER).groupBy("attribution_run_id").agg(
        F.sum(F.abs("contribution_bps")).alias("gross_bps")
    )
    observed, residual = F.col("observed_return_bps"), F.col("unexplained_residual_bps")
    denominator = share_denominator(observed, threshold)
    stable = share_is_stable(observed, threshold)
    measured = runs.join(gross, "attribution_run_id", "left").select(
        "model_version",
        "observed_return_bps",
        "unexplained_residual_bps",
        (F.coalesce("gross_bps", F.lit(0.0)) / denominator).alias("gross_leverage"),
        (F.abs(residual) / denominator).alias("residual_leverage"),
    )
    stable_sum = F.sum(F.when(stable, F.abs(observed)))
    main = measured.groupBy("model_version").agg(
        F.count("*").alias("runs"),
        F.count_if(stable).alias("stable_runs"),
        (F.count_if(stable) / F.count("*")).alias("stable_share_coverage"),
        F.avg(F.abs(residual)).alias("residual_mae_bps"),
        F.sqrt(F.avg(residual * residual)).alias("residual_rmse_bps"),
        F.try_divide(F.sum(F.when(stable, F.abs(residual))), F.when(stable_sum > 0, stable_sum)).alias(
            "weighted_abs_residual_share"
        ),
    )
    tails = [
        nearest_rank(measured, ["model_version"], column, 0.95).withColumnRenamed("percentile", f"{column}_p95")
        for column in ("gross_leverage", "residual_leverage")
    ]
    return reduce(lambda a, b: a.join(b, "model_version"), tails, main)


def percent_complete(done: Column, expected: Column) -> Column:
    return F.when(expected > 0, F.least(done / expected * 100.0, F.lit(100.0)))


def cadence_progress(expected_windows: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs, securities and completion per cadence against the windows that should exist."""
    expected = expected_windows.groupBy("cadence").agg(F.count("*").alias("expected_windows"))
    done = runs.groupBy("cadence").agg(
        F.count("*").alias("runs"),
        F.count_distinct("security_id").alias("tickers_with_runs"),
        F.max("created_at").alias("latest_created_at"),
    )
    n = F.coalesce("runs", F.lit(0))
    return expected.join(done, "cadence", "left").select(
        "cadence",
        n.alias("runs"),
        F.coalesce("tickers_with_runs", F.lit(0)).alias("tickers_with_runs"),
        "expected_windows",
        F.greatest(F.col("expected_windows") - n, F.lit(0)).alias("remaining_windows"),
        percent_complete(n, F.col("expected_windows")).alias("percent_complete"),
        "latest_created_at",
    )


def task_progress(tasks: DataFrame) -> DataFrame:
    """Window totals and number of tasks per status."""
    return tasks.groupBy("status").agg(
        F.count("*").alias("tasks"),
        F.sum("expected_windows").alias("expected_windows"),
        F.sum("ran_windows").alias("ran_windows"),
        F.sum("skipped_windows").alias("skipped_windows"),
    )


def coverage_report(windows: DataFrame, runs: DataFrame, target: float = 0.95) -> DataFrame:
    """Expected, run and skipped windows per cadence and whether each reaches the target."""
    key = ["security_id", "cadence", "window_start", "window_end"]
    marked = windows.select(*key).join(runs.select(*key, F.lit(1).alias("ran")), key, "left")
    counts = marked.groupBy("cadence").agg(
        F.count("*").alias("expected"), F.count("ran").alias("ran"), F.count_if(F.col("ran").isNull()).alias("skipped")
    )
    return counts.withColumn("reached", (F.col("expected") > 0) & (F.col("ran") / F.col("expected") >= target))


def coverage_success(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.bool_and("reached"), F.lit(False)).alias("success"))


def top_skip_reasons(skipped: DataFrame, n: int = 5) -> DataFrame:
    return skipped.groupBy("skip_reason").count().orderBy(F.col("count").desc(), "skip_reason").limit(n)


def data_coverage(members: DataFrame, bars: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Named counts of members, priced members and stored rows, one row each."""

    def one(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(value.cast("string").alias("value")).select(F.lit(name).alias("metric"), "value")

    owners = bars.select("security_id").distinct()
    everyone = members.select("security_id").distinct()
    rows = F.count("*")
    parts = [
        one("universe_members", members, rows),
        one("eligible_members", members, F.count_if(F.col("eligibility_status") == "eligible")),
        one("priced_members", everyone.join(owners, "security_id", "left_semi"), rows),
        one("missing_price_members", everyone.join(owners, "security_id", "left_anti"), rows),
        one("price_bar_rows", bars, rows),
        one("latest_price_date", bars, F.max("event_date")),
        *[one(f"{name}_rows", df, rows) for name, df in tables.items()],
    ]
    return reduce(DataFrame.unionByName, parts)


def count_by(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    inside = df.where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return inside.groupBy(column).agg(F.count("*").alias("rows"))


def usable_baskets(members: DataFrame, min_members: int = 3) -> DataFrame:
    sizes = members.groupBy("peer_basket_id").agg(F.count("*").alias("members"))
    return sizes.where(F.col("members") >= min_members).agg(F.count("*").alias("usable_peer_baskets"))


def feedback_verdicts(feedback: DataFrame, runs: DataFrame, parts: DataFrame) -> DataFrame:
    """Feedback with the reason it is refused, null when it is accepted."""
    known_run = runs.select("run_id").distinct().withColumn("_run", F.lit(True))
    known_part = parts.select("run_id", "contribution_id").distinct().withColumn("_part", F.lit(True))
    looked = feedback.join(known_run, "run_id", "left").join(known_part, ["run_id", "contribution_id"], "left")
    # Feedback an analyst may give.
    allowed = ["correct", "partially_correct", "wrong", "missing_driver"]
    nameless = F.coalesce("missing_driver_name", F.lit("")) == ""
    reason = (
        F.when(~F.col("feedback").isin(allowed), "feedback not allowed")
        .when((F.col("feedback") == "missing_driver") & nameless, "missing_driver needs a name")
        .when(F.col("_run").isNull(), "attribution run not found")
        .when(F.col("contribution_id").isNotNull() & F.col("_part").isNull(), "contribution not found for run")
    )
    return looked.withColumn("rejection_reason", reason).drop("_run", "_part")

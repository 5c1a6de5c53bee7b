"""Filing events: taxonomy, feature scores, surprises and their place in attribution windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.functions.scoring import numeric_surprise, surprise_direction
from returnlens.operators.pit import visible
from returnlens.session import settle

TAXONOMY_VERSION = "event-taxonomy-v0"
FEATURE_VERSION = "edgar-feature-heuristic-v0"
SURPRISE_VERSION = "event-surprise-v0"

# Form type to (category, subtype, direction, materiality).
FORM_TAXONOMY = {
    "8-K": ("corporate_event", "current_report", "mixed", 0.70),
    "10-K": ("periodic_results", "annual_report", "mixed", 0.65),
    "10-Q": ("periodic_results", "quarterly_report", "mixed", 0.55),
    "13D": ("ownership", "activist_or_large_holder", "mixed", 0.75),
    "SC 13D": ("ownership", "activist_or_large_holder", "mixed", 0.75),
    "13G": ("ownership", "passive_large_holder", "mixed", 0.50),
    "SCHEDULE 13G": ("ownership", "passive_large_holder", "mixed", 0.50),
    "4": ("insider_activity", "form_4", "mixed", 0.35),
    "144": ("insider_activity", "planned_sale", "negative", 0.25),
}
# 8-K item code to (category, subtype, direction, materiality).
ITEM_TAXONOMY = {
    "2.02": ("earnings", "results_of_operations", "mixed", 0.90),
    "2.05": ("restructuring", "exit_or_disposal", "mixed", 0.75),
    "2.06": ("accounting", "material_impairment", "negative", 0.85),
    "5.02": ("management", "officer_or_director_change", "mixed", 0.65),
    "7.01": ("disclosure", "reg_fd", "mixed", 0.50),
    "8.01": ("corporate_event", "other_event", "mixed", 0.55),
    "9.01": ("disclosure", "financial_statements_exhibits", "mixed", 0.35),
}
# Fixed value: what an unknown form is.
OTHER_TAXONOMY = ("general_disclosure", "unclassified", "mixed", 0.25)
# Payload keys that may hold the item code, in order.
ITEM_KEYS = ["item", "item_code", "eight_k_item", "8k_item"]

# Form type to (relevance, novelty, magnitude, exposure match).
FORM_SCORES = {
    "8-K": (0.95, 0.75, 0.70, 0.70),
    "10-K": (0.90, 0.55, 0.65, 0.60),
    "10-Q": (0.85, 0.45, 0.55, 0.55),
    "SCHEDULE 13G": (0.80, 0.70, 0.50, 0.65),
    "13G": (0.80, 0.70, 0.50, 0.65),
    "4": (0.65, 0.35, 0.25, 0.35),
    "144": (0.55, 0.30, 0.20, 0.30),
}
# Scores of any other form, and the source whose events count as official.
OTHER_SCORES = (0.50, 0.30, 0.20, 0.25)
OFFICIAL_SOURCES = ["sec_edgar"]


def _entry(row: tuple, names: list[str]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)])


def _lookup(table: dict[str, tuple], names: list[str]) -> Column:
    parts = []
    for key, row in table.items():
        parts += [F.lit(key), _entry(row, names)]
    return F.create_map(*parts)


def item_code(payload: Column) -> Column:
    """First item code present in a JSON payload, trimmed."""
    found = [F.get_json_object(payload, f"$['{key}']") for key in ITEM_KEYS]
    return F.trim(F.coalesce(*found))


def classify(events: DataFrame) -> DataFrame:
    """Events with category, subtype, direction and materiality."""
    names = ["event_category", "event_subtype", "event_direction", "materiality"]
    form = F.upper("event_type")
    code = item_code(F.col("structured_payload"))
    by_item = F.when(form == "8-K", F.try_element_at(_lookup(ITEM_TAXONOMY, names), code))
    by_form = F.try_element_at(_lookup(FORM_TAXONOMY, names), form)
    return events.withColumn("_t", F.coalesce(by_item, by_form, _entry(OTHER_TAXONOMY, names))).select(
        *events.columns,
        code.alias("eight_k_item_code"),
        "_t.*",
        F.lit(TAXONOMY_VERSION).alias("taxonomy_version"),
    )


def event_features(events: DataFrame, official_sources: list[str] = OFFICIAL_SOURCES) -> DataFrame:
    """Heuristic feature scores of each event; ids and times carry over."""
    names = ["relevance", "novelty", "magnitude", "exposure_match"]
    scores = F.coalesce(
        F.try_element_at(_lookup(FORM_SCORES, names), F.upper("event_type")), _entry(OTHER_SCORES, names)
    )
    return events.withColumn("_s", scores).select(
        "event_id",
        "company_id",
        "security_id",
        "event_time",
        "ingestion_time",
        "timestamp_available",
        "_s.*",
        F.lit(0.0).alias("sentiment"),
        F.when(F.col("source").isin(official_sources), 1.0).otherwise(0.7).alias("source_credibility"),
        F.lit(0.0).alias("surprise"),
        F.concat(
            F.lit("source="), "source", F.lit("; form="), "event_type", F.lit("; accession="), "source_id"
        ).alias("evidence_span"),
        F.lit(FEATURE_VERSION).alias("model_version"),
    )


def event_surprises(figures: DataFrame) -> DataFrame:
    """Actual against expected, scaled by the given scale or the size of the expectation."""
    value = numeric_surprise(F.col("actual_value"), F.col("expected_value"), F.col("scale"))
    return figures.withColumn("surprise_value", value).select(
        *[c for c in figures.columns if c != "scale"],
        "surprise_value",
        surprise_direction(F.col("surprise_value")).alias("direction"),
        F.lit(SURPRISE_VERSION).alias("model_version"),
    )


def events_in_windows(windows: DataFrame, events: DataFrame, securities: DataFrame, cutoff: str) -> DataFrame:
    """Visible events of each window's company inside the closed window.

    Windows are laid out over the days they span, so the join runs on company and day and each event meets only the
    few windows around it; the exact time bounds follow. The days laid out are written first: where they are few, the
    planner then knows, and the events stay where they are.
    """
    owned = windows.join(securities.select("security_id", "company_id"), "security_id")
    spread = settle(owned.withColumn("event_day", F.explode(F.sequence("window_start", "window_end"))), "window-days")
    dated = visible(events, cutoff).drop("security_id").withColumn("event_day", F.col("event_time").cast("date"))
    start, end = F.col("window_start").cast("timestamp_ntz"), F.col("window_end").cast("timestamp_ntz")
    return (
        spread.join(dated, ["company_id", "event_day"])
        .where((F.col("event_time") >= start) & (F.col("event_time") <= end))
        .drop("event_day")
    )

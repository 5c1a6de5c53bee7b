"""Rounding, percentiles, limits and look-ahead on rows made for them."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnlens.functions.scoring import fixed_text
from returnlens.operators import quality, reports


def test_text_of_numbers_is_that_of_the_stored_value(spark):
    values = [12.25, 12.75, 12.35, -12.25, -0.04, 0.0, 1234.55, 98765.4321]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(fixed_text(F.col("v"), 1).alias("t")).collect()
    assert [r["t"] for r in rows] == [f"{v:.1f}" for v in values]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_lookahead_does_not_depend_on_the_time_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        cutoff = datetime.datetime(2001, 6, 1)
        runs = spark.createDataFrame([("r", cutoff)], "attribution_run_id string, attribution_cutoff timestamp_ntz")
        stated = ["2001-06-01T02:00:00Z", "2001-05-31T23:00:00Z", "2001-05-31T22:30:00-02:00", "2001-06-01T01:00:00+02:00", "nonsense"]
        parts = spark.createDataFrame([("r", "event", str(i), f'{{"timestamp_available": "{t}"}}') for i, t in enumerate(stated)] + [("r", "event", "none", "{}")], "attribution_run_id string, driver string, name string, evidence_payload string")
        assert {r["name"] for r in quality.lookahead_breaks(runs, parts).collect()} == {"0", "2"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_nearest_rank_is_exact(spark):
    rng = np.random.default_rng(2)
    groups = {
        "wide": np.concatenate([rng.normal(0, 1, 500), rng.normal(0, 1e9, 5)]), "near": 1 + rng.integers(0, 40, 700) * 1e-9, "one": np.full(30, 2.5), "single": np.array([7.0]),
        "ties": rng.integers(0, 3, 401).astype(float),
    }
    rows = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("one", None)], "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: r["percentile"] for r in reports.nearest_rank(rows, ["k"], "v", q).collect()}
        assert got == {k: float(np.sort(v)[round((len(v) - 1) * q)]) for k, v in groups.items()}


def test_history_gives_what_is_asked(spark):
    start = datetime.date(2000, 1, 1)
    runs = spark.createDataFrame([(str(i), "daily", start + datetime.timedelta(i), i) for i in range(320)], "attribution_run_id string, cadence string, window_end date, created_at long")
    assert reports.run_history(runs, 300).count() == 300 and reports.run_history(runs, 3, "daily").first()["attribution_run_id"] == "319"

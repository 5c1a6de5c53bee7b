"""Range maxima against a plain version, windows touched by late rows, the order audit, and times in a repeated hour."""

import datetime as dt
import random

from pyspark.sql import functions as F

from returnlens.functions.parsing import utc_timestamp
from returnlens.operators import availability, quality

DAY0 = dt.date(2000, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def test_range_maxima_against_every_row(spark):
    rng = random.Random(4)
    facts = [(kind, f"k{rng.randint(0, 2)}", day(rng.randint(0, 400)), rng.randint(0, 10_000)) for kind in ("bar", "macro") for _ in range(150)]
    facts += [("bar", "lone", day(7), 5)]
    asked = []
    for _ in range(300):
        low = rng.randint(-40, 420)
        asked.append((rng.choice(["bar", "macro"]), f"k{rng.randint(0, 3)}", day(low), day(low + rng.choice([0, 1, 2, 6, 31, 63, 64, 65, 260]))))
    asked += [("bar", "lone", day(7), day(7)), ("bar", "lone", day(8), day(9)), ("bar", "k0", day(9), day(3)), asked[0]]
    found = availability.range_maxima(
        spark.createDataFrame(asked, "kind string, key string, low date, high date"), spark.createDataFrame(facts, "kind string, key string, event_date date, value long")
    )
    got = {(r["kind"], r["key"], r["low"], r["high"]): r["newest"] for r in found.collect()}
    want = {(k, x, a, b): max((v for kk, xx, d, v in facts if (kk, xx) == (k, x) and a <= d <= b), default=None) for k, x, a, b in asked if a <= b}
    assert got == want


def test_range_maxima_of_nothing(spark):
    asked = spark.createDataFrame([("bar", "k", day(1), day(3))], "kind string, key string, low date, high date")
    facts = spark.createDataFrame([], "kind string, key string, event_date date, value long")
    assert [r["newest"] for r in availability.range_maxima(asked, facts).collect()] == [None]
    assert availability.range_maxima(asked.limit(0), facts).count() == 0


def test_stale_windows_are_those_that_read_something_new(spark):
    windows = spark.createDataFrame([(s, "weekly", day(a), day(a + 4)) for s in (1, 2) for a in (100, 110, 300)], "security_id long, cadence string, window_start date, window_end date")
    uses = spark.createDataFrame([(1, "bar", "1", 20), (2, "bar", "2", 20), (2, "peer", "1", 20), (1, "event", "c", 0)], "security_id long, kind string, key string, back int")
    early, late = dt.datetime(2001, 1, 1), dt.datetime(2002, 1, 1)
    facts = spark.createDataFrame(
        [("bar", str(s), day(n), early) for s in (1, 2) for n in range(60, 310)] + [("peer", "1", day(85), late), ("event", "c", day(304), late), ("event", "c", day(305), late)],
        "kind string, key string, event_date date, value timestamp_ntz",
    )
    standing = spark.createDataFrame([(1, "classification", early)], "security_id long, kind string, value timestamp_ntz")
    newest = availability.newest_inputs(windows, uses, facts, standing)
    touched = availability.stale_windows(windows, newest, "2001-06-01 00:00:00").collect()
    assert sorted((r["security_id"], (r["window_start"] - DAY0).days) for r in touched) == [(1, 300), (2, 100)]
    assert {r["kind"] for r in newest.collect()} == {"bar", "peer", "event", "classification"}


def test_systematic_rows_after_an_event(spark):
    rows = [(1, "market", 1), (1, "event", 2), (1, "macro", 3), (1, "unexplained_residual", 4), (2, "macro", 2), (2, "event", 1), (2, "event", 3), (3, "macro", 9)]
    placed = spark.createDataFrame(rows, "run long, driver string, position int")
    found = quality.systematic_order_breaks(placed, ["run"]).select("run", "driver", "position").collect()
    assert sorted(map(tuple, found)) == [(1, "macro", 3), (2, "macro", 2)]


def test_times_in_the_repeated_hour(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    texts = {"2001-10-28T06:30:00Z": "2001-10-28 06:30:00", "2001-10-28T05:30:00Z": "2001-10-28 05:30:00", "2001-10-28T01:30:00-05:00": "2001-10-28 06:30:00",
             "2001-04-01T07:30:00.250000Z": "2001-04-01 07:30:00.25", "2001-10-28": "2001-10-28 00:00:00", "1969-12-31T23:59:59.5Z": "1969-12-31 23:59:59.5", "no time": None}
    try:
        for zone in ("America/New_York", "UTC", "Europe/Berlin"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", utc_timestamp(F.col("t")).cast("string").alias("u"))
            assert {r["t"]: r["u"] for r in df.collect()} == texts
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)

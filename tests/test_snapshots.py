"""The snapshot store: what a reader sees while writes fail, race and follow one another."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from returnlens.operators.snapshots import Conflict, SnapshotStore

KEY = ["security_id", "event_date"]


def rows(spark, items):
    return spark.createDataFrame([(s, dt.date.fromisoformat(d), c, v) for s, d, c, v in items], "security_id long, event_date date, close double, version int")


def seen(df):
    return sorted((r["security_id"], r["event_date"].isoformat(), r["close"]) for r in df.collect())


FIRST = [(1, "2001-01-03", 10.0, 1), (2, "2001-01-04", 20.0, 1), (1, "2001-02-01", 11.0, 1), (2, "2001-03-01", 21.0, 1)]
SECOND = [(1, "2001-01-03", 99.0, 2), (1, "2001-01-03", 98.0, 1), (3, "2001-02-02", 30.0, 1)]
AFTER = [(1, "2001-01-03", 99.0), (1, "2001-02-01", 11.0), (2, "2001-01-04", 20.0), (2, "2001-03-01", 21.0), (3, "2001-02-02", 30.0)]


def test_merge_replaces_touched_months_only(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "bars"))
    assert store.read() is None and store.versions() == []
    assert store.merge(rows(spark, FIRST), KEY, [F.col("version").desc()]) == 1
    before = store.read()
    assert store.merge(rows(spark, SECOND), KEY, [F.col("version").desc()]) == 2
    assert seen(store.read()) == AFTER
    assert seen(before) == seen(store.read(1)) == sorted((s, d, c) for s, d, c, _ in FIRST)  # bound to what it opened
    assert store.manifest(1)["2001-03"] == store.manifest(2)["2001-03"] and store.manifest(1)["2001-01"] != store.manifest(2)["2001-01"]


def test_a_write_that_fails_between_months_leaves_the_old_state(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "bars"))
    store.write(rows(spark, FIRST))
    fails = F.when(F.col("event_date") == F.lit("2001-02-02").cast("date"), F.raise_error(F.lit("lost between months"))).otherwise(F.col("close"))
    with pytest.raises(Exception, match="lost between months"):
        store.write(rows(spark, SECOND).withColumn("close", fails.cast("double")))
    assert seen(store.read()) == sorted((s, d, c) for s, d, c, _ in FIRST) and store.versions() == [1]
    base, staged = store.stage(rows(spark, SECOND[:1]))  # all months written, the manifest not yet swapped
    assert seen(store.read()) == sorted((s, d, c) for s, d, c, _ in FIRST)
    store.publish(base, staged)
    assert ("2001-01-03", 99.0) in {(d, c) for _, d, c in seen(store.read())}


def test_of_two_writers_on_one_version_one_wins(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "bars"))
    store.write(rows(spark, FIRST))
    one, two = store.stage(rows(spark, FIRST[:2])), store.stage(rows(spark, SECOND[2:]))
    assert store.publish(*one) == 2
    with pytest.raises(Conflict):
        store.publish(*two)
    assert store.versions() == [1, 2]


def test_vacuum_keeps_what_the_newest_versions_read(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "bars"))
    for day in ("2001-01-03", "2001-01-04", "2001-02-05"):
        store.merge(rows(spark, [(1, day, 1.0, 1)]), KEY, [F.col("version").desc()])
    store.stage(rows(spark, FIRST))  # an attempt that was never published
    store.vacuum(keep=1)
    assert store.versions() == [3] and len(seen(store.read())) == 3

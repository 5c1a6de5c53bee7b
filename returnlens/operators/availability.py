"""Newest availability of what each window reads, by range maxima over doubling spans of days.

A window reads facts of several keys (its own bars, its factors, the returns of its peers ...), each over a range of days.
For every key the maximum over spans of 1, 2, 4 ... days is built by doubling along the calendar, and a range of any
length is the larger of the two spans of the greatest fitting length that start and end with it. So a window costs two
lookups a key, however long its lookback, and a key costs a row a day and length in use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from returnlens.operators.windows import WINDOW
from returnlens.session import settle

RANGE = ["kind", "key", "low", "high"]


def range_maxima(asked: DataFrame, facts: DataFrame) -> DataFrame:
    """``asked`` (kind, key, low, high; days, both included) with ``newest``, the largest ``value`` of ``facts`` inside.

    ``facts`` has kind, key, event_date and value, any number of rows a day; null where a range holds none. Ranges whose
    end lies before their start are dropped.
    """
    day = F.unix_date
    ranges = asked.select(*RANGE, day("low").alias("a"), day("high").alias("b")).where("a <= b").distinct()
    ranges = settle(ranges.withColumn("level", F.floor(F.log2(F.col("b") - F.col("a") + 1)).cast("int")), "ranges")
    # At most one level for every power of two up to the length of the calendar.
    levels = sorted(r["level"] for r in ranges.select("level").distinct().collect())
    bounds = ranges.groupBy("kind", "key").agg(F.min("a").alias("first"), F.max("b").alias("last"))
    daily = facts.groupBy("kind", "key", day("event_date").alias("day")).agg(F.max("value").alias("m0"))
    calendar = bounds.select("kind", "key", F.explode(F.sequence("first", "last")).alias("day"))
    table = calendar.join(daily, ["kind", "key", "day"], "left")
    along = Window.partitionBy("kind", "key").orderBy("day")
    for level in range(max(levels, default=0)):
        table = table.withColumn(f"m{level + 1}", F.greatest(f"m{level}", F.lead(f"m{level}", 1 << level).over(along)))
    spans = F.array(*[F.struct(F.lit(k).alias("level"), F.col(f"m{k}").alias("m")) for k in levels or [0]])
    table = settle(table.select("kind", "key", "day", F.inline(spans)).where(F.col("m").isNotNull()), "spans")
    first = table.select("kind", "key", "level", F.col("day").alias("a"), F.col("m").alias("from_low"))
    last = table.select("kind", "key", "level", F.col("day").alias("end_span"), F.col("m").alias("to_high"))
    found = ranges.join(first, ["kind", "key", "level", "a"], "left")
    found = found.withColumn("end_span", F.expr("b - shiftleft(1, level) + 1")).join(last, ["kind", "key", "level", "end_span"], "left")
    return found.select(*RANGE, F.greatest("from_low", "to_high").alias("newest"))


def newest_inputs(windows: DataFrame, uses: DataFrame, facts: DataFrame, standing: DataFrame) -> DataFrame:
    """(window, kind, inputs_available): the newest availability among the inputs of each kind that a window reads.

    ``uses``: security_id, kind, key, back: the window reads the key from ``back`` days before its start to its end.
    ``standing``: security_id, kind, value: rows that hold for all windows of a security. Kinds of which a window reads
    nothing have no row.
    """
    owned = windows.select(*WINDOW).join(uses, "security_id").select(
        *WINDOW, "kind", "key", F.expr("date_sub(window_start, back)").alias("low"), F.col("window_end").alias("high")
    )
    newest = range_maxima(owned, facts).where(F.col("newest").isNotNull())
    ranged = owned.join(newest, RANGE).select(*WINDOW, "kind", F.col("newest").alias("value"))
    held = windows.select(*WINDOW).join(standing, "security_id").select(*WINDOW, "kind", "value")
    return ranged.unionByName(held).groupBy(*WINDOW, "kind").agg(F.max("value").alias("inputs_available"))


def stale_windows(windows: DataFrame, newest: DataFrame, since: str) -> DataFrame:
    """Windows that read something which became available after ``since``."""
    late = newest.where(F.col("inputs_available") > F.lit(since).cast("timestamp_ntz")).select(*WINDOW).distinct()
    return windows.join(late, WINDOW, "left_semi")


def together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

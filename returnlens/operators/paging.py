"""Deep pages of a large ordering without sorting everything up to the page.

Rows are dealt into ranges of the ordering and written; the size of each range is known, so a page is looked for only in the
ranges it overlaps. One ordering serves any number of pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnlens.session import settle


class Pages:
    """``order`` must be total: rows that tie in it may change places between pages."""

    def __init__(self, df: DataFrame, order: list[Column], ranges: int | None = None):
        self.columns, self.order = df.columns, order
        parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows = settle(df.repartitionByRange(parts, *order).withColumn("page_range", F.spark_partition_id()), "pages")
        # One row a range.
        sizes = sorted((r["page_range"], r["count"]) for r in self.rows.groupBy("page_range").count().collect())
        self.starts, self.total = {}, 0
        for part, size in sizes:
            self.starts[part] = (self.total, self.total + size)
            self.total += size

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` of the ordering with their ``position`` from 0; fewer, or none, past its end."""
        last = offset + limit
        inside = {part: first for part, (first, end) in self.starts.items() if first < last and end > offset}
        first = F.create_map(*[F.lit(x) for pair in inside.items() for x in pair]) if inside else None
        held = self.rows.where(F.col("page_range").isin(list(inside)))
        place = F.row_number().over(Window.partitionBy("page_range").orderBy(*self.order)) - 1
        base = F.element_at(first, F.col("page_range")) if inside else F.lit(0)
        placed = held.withColumn("position", (place + base).cast("long"))
        return placed.where((F.col("position") >= offset) & (F.col("position") < last)).select("position", *self.columns)

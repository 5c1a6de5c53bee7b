"""Sharding by longest processing time: groups of equal texts, largest first, each to the least loaded shard.

Law ``bytes``: the shards' sizes are near equal, and rows with equal texts share a shard.

A heap cannot hold every group of a large corpus, so it holds a bounded number of units. A group with more than
``1/heavy`` of all bytes is a unit of its own (there are at most ``heavy`` of them); the rest fall by the hash of their text
into ``cells`` units of whole groups. Cells come in two widths, so the last units placed are tiny and even out what the
large ones left. A group larger than a fair share keeps its shard to itself; its size is then the floor for any placement
that keeps groups together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnlens.llm.common import small
from returnlens.session import settle

_NUMBERED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("text_crc32", T.LongType()),
    T.StructField("shard", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("nth", T.LongType()),
])


def least_loaded(sizes: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Longest processing time first; ties go by name, then to the lower shard."""
    heap = [(0, s) for s in range(shards)]
    placed = {}
    for size, name in sorted(sizes, key=lambda x: (-x[0], x[1])):
        load, shard = heapq.heappop(heap)
        placed[name] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def _number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the rows of each shard inside this task."""
    task, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        nth = batch.groupby("shard").cumcount() + batch["shard"].map(seen).fillna(0).astype("int64")
        for shard, count in batch["shard"].value_counts().items():
            seen[shard] = seen.get(shard, 0) + int(count)
        yield batch.assign(task=task, nth=nth)


def shard(docs: DataFrame, shards: int = 8, heavy: int = 8192, cells: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    A null text has size 1 and the checksum of an empty text, and is grouped with empty texts. Null or repeated ids and
    repeated rows are placed like any others, an empty table gives no rows, and other columns of ``docs`` are not read.
    Slots count the rows of a shard from 0: each task numbers its own rows per shard, the numbered rows are written, and a
    prefix sum over the tasks' counts turns them into places, so no shard meets in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    wide = F.pmod(F.xxhash64("group_key"), F.lit(cells))
    fine = F.pmod(F.xxhash64("group_key", F.lit(1)), F.lit(cells))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("group_key"),
    )
    # One cell in 16 is cut into as many fine cells as there are wide ones.
    base = base.withColumn("cell", F.when(wide < cells // 16, F.concat(F.lit("f"), fine.cast("string"))).otherwise(F.concat(F.lit("w"), wide.cast("string"))))
    groups = settle(base.groupBy("group_key", "cell").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    is_heavy = F.col("bytes") > total / heavy
    units = groups.groupBy(F.when(is_heavy, F.col("group_key")).otherwise(F.col("cell")).alias("unit")).agg(F.sum("bytes").alias("bytes"))
    # At most heavy + 2 * cells rows, whatever the table.
    sizes = [(r["bytes"], r["unit"]) for r in units.collect()]
    placed = least_loaded(sizes, shards)
    spark = docs.sparkSession
    places = spark.createDataFrame(list(placed.items()) or [("", 0)], "unit string, shard int")
    alone = F.broadcast(places.where(F.length("unit") == 32).select(F.col("unit").alias("group_key"), F.col("shard").alias("own")))
    shared = F.broadcast(places.where(F.length("unit") < 32).select(F.col("unit").alias("cell"), F.col("shard").alias("common")))
    rows = base.join(alone, "group_key", "left").join(shared, "cell", "left")
    rows = rows.select("doc_id", "size", "text_crc32", F.coalesce("own", "common").alias("shard"))
    numbered = settle(rows.mapInPandas(_number, _NUMBERED), "numbered")
    counts = numbered.groupBy("shard", "task").agg(F.count(F.lit(1)).alias("rows"))
    before = _before(counts)
    return numbered.join(small(before), ["shard", "task"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("nth")).alias("slot"))


def _before(counts: DataFrame) -> DataFrame:
    """Rows of earlier tasks in the same shard; one row per shard and task, so a window per shard is as long as the tasks are many."""
    from pyspark.sql import Window

    w = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("shard", "task", F.coalesce(F.sum("rows").over(w), F.lit(0)).alias("first"))

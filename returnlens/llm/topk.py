"""Exact top-k by integer inner product over a bit-sliced index.

A block of vectors is indexed by bitmaps: for each attribute and each of its upper bits, the rows that have the bit. A
query's scores are formed for all rows of a block at once by adding the slices of its attributes, weighted by the bits of
the query, with bitmap arithmetic. The slices of the sum are then read from the most significant downward to find the k-th
largest value, and once more to find every row that the bits left out of the index could still lift to it. Those boundary
rows are scored exactly.

Blocks of the table meet blocks of queries; each meeting returns k rows a query, and the best k of all remain. The
number of meetings is that of queries against rows. A block of the table stays in one place and the queries, far fewer, are
copied to it, so the table is shuffled a fixed number of times; meetings are handed to Python one at a time, and the index
of a block serves all meetings it has in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from returnlens.llm.common import arrow_batches
from returnlens.session import settle

DROPPED_BITS = 2
# Rows of a block below which adding bitmaps costs less than the calls that add them.
LEAST = 4096
_FOUND = "query_id long, vec_id long, score long"


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null unless all components are finite numbers."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _pack(kind: str):
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        rows = np.array(group["vector"].tolist(), dtype=np.int64).reshape(len(group), -1)
        return pd.DataFrame({"dim": [rows.shape[1]], kind: [int(group["block"].iloc[0])], "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "rows": [rows.tobytes()]})

    return pack


class Index:
    """Bitmaps of the upper bits of every attribute over the rows of a block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, dropped: int = DROPPED_BITS):
        self.ids, self.rows = ids, rows
        self.low = rows.min(axis=0)
        span = int((rows.max(axis=0) - self.low).max())
        self.bits = max(1, span.bit_length())
        self.dropped = min(dropped, self.bits - 1)
        self.size = len(ids)
        shifted = (rows - self.low).astype(np.uint64)
        pad = -self.size % 64
        self.live = self._bitmap(np.ones(self.size, bool), pad)
        self.slices = np.array([[self._bitmap((shifted[:, d] >> np.uint64(t)) & np.uint64(1) == 1, pad) for t in range(self.dropped, self.bits)] for d in range(rows.shape[1])])

    @staticmethod
    def _bitmap(flags: np.ndarray, pad: int) -> np.ndarray:
        return np.packbits(np.concatenate([flags, np.zeros(pad, bool)]), bitorder="little").view(np.uint64)

    def _sum(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum over attributes of |q| times the indexed bits, taken from the other end where q < 0.

        All bitmaps of one weight are added at once, three of them to a sum and a carry into the next weight, until one is
        left. The number of numpy calls hardly depends on the number of attributes, nor on the rows of the block.
        """
        sizes, turned = np.abs(query), query < 0
        longest = int(sizes.max()).bit_length()
        levels: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        weights = longest + self.slices.shape[1] - 1 if longest else 0
        while carried or len(levels) < weights:
            at = len(levels)
            picked, carried = carried, []
            for t in range(max(0, at - longest + 1), min(at + 1, self.slices.shape[1])):
                dims = np.flatnonzero(sizes >> (at - t) & 1)
                bitmaps = self.slices[dims, t]
                bitmaps[turned[dims]] ^= self.live
                picked.append(bitmaps)
            stack = np.concatenate(picked)
            while len(stack) > 2:
                third = len(stack) // 3
                a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                either = a ^ b
                carried.append(a & b | either & c)
                stack = np.concatenate([either ^ c, stack[3 * third :]])
            if len(stack) == 2:
                carried.append(stack[:1] & stack[1:])
                stack = stack[:1] ^ stack[1:]
            levels.append(stack[0] if len(stack) else np.zeros_like(self.live))
        return levels

    def _kth(self, levels: list[np.ndarray], k: int) -> int:
        """The k-th largest value of the sums, from the most significant slice downward."""
        sure, open_, value = np.zeros_like(self.live), self.live, 0
        for at in range(len(levels) - 1, -1, -1):
            with_bit = open_ & levels[at]
            if int(np.bitwise_count(sure | with_bit).sum()) >= k:
                open_, value = with_bit, value | 1 << at
            else:
                sure, open_ = sure | with_bit, open_ & ~levels[at]
        return value

    def _at_least(self, levels: list[np.ndarray], value: int) -> np.ndarray:
        above, equal = np.zeros_like(self.live), self.live
        for at in range(max(len(levels), value.bit_length()) - 1, -1, -1):
            bits = levels[at] if at < len(levels) else np.zeros_like(self.live)
            if value >> at & 1:
                equal = equal & bits
            else:
                above, equal = above | (equal & bits), equal & ~bits
        return above | equal

    def top(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows whose id is not the query's; ties to the smaller id."""
        want = min(self.size, k + int((self.ids == query_id).sum()))
        levels = self._sum(query)
        # The bits left out add at most their largest value for each unit of |q|.
        lift = int(np.abs(query).sum()) * ((1 << self.dropped) - 1)
        reach = max(0, self._kth(levels, want) - -(-lift >> self.dropped) - 1)
        bitmap = self._at_least(levels, reach)
        near = np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[:self.size])
        near = near[self.ids[near] != query_id]
        scores = self.rows[near] @ query
        order = np.lexsort((self.ids[near], -scores))[:k]
        return self.ids[near][order], scores[order]


def _meet(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, index = None, None
        for batch in batches:
            for row in batch.itertuples():
                dim = row.dim
                if held != (dim, row.part):
                    index = None  # before the next is built
                    held, index = (dim, row.part), Index(np.frombuffer(row.ids, np.int64), np.frombuffer(row.rows, np.int64).reshape(-1, dim))
                query_ids = np.frombuffer(row.query_ids, np.int64)
                queries = np.frombuffer(row.query_rows, np.int64).reshape(-1, dim)
                found = [index.top(query_id, query, k) for query_id, query in zip(query_ids.tolist(), queries, strict=True)]
                yield pd.DataFrame({
                    "query_id": np.repeat(query_ids, [len(ids) for ids, _ in found]),
                    "vec_id": np.concatenate([ids for ids, _ in found]),
                    "score": np.concatenate([scores for _, scores in found]),
                })

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block: int = 32_768, query_block: int = 1024, tasks: int = 24, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest scores of every query against all rows but its own.

    ``is_query`` is a condition on the column ``vec_id``. Vectors that are null or hold null or non-finite components, and
    rows with a null id, take no part; vectors meet vectors of their own length only, and empty ones none. Repeated ids: a
    query is asked once, with one of its vectors, and no row with its id is a candidate; another repeated candidate may
    fill several ranks. Fewer rows than ``k`` give fewer ranks, an empty table none, and other columns are not read.
    Scaled components and scores are 64-bit integers and must fit into them.

    The table is cut into blocks of at most about ``block`` rows, and into ``tasks`` blocks if they then hold ``LEAST`` rows;
    queries into blocks of at most ``query_block``. Blocks are dealt over a fixed number of partitions, as joining several
    small ones to one task would leave all meetings to a few tasks.
    """
    whole = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col), scale).alias("vector")).where("vec_id is not null and size(vector) > 0")
    whole = whole.withColumn("dim", F.size("vector"))
    asked = whole.where(is_query)
    total, queries = whole.count(), asked.count()
    blocks = max(1, min(tasks, -(-total // LEAST)), -(-total // block))
    places = max(blocks, 4 * min(blocks, tasks))
    asked_blocks = max(1, -(-queries // query_block))

    def packed(df: DataFrame, kind: str, parts: int) -> DataFrame:
        spread = df.withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int"))
        return spread.groupBy("dim", "block").applyInPandas(_pack(kind), f"dim int, {kind} int, ids binary, rows binary")

    table = packed(whole, "part", blocks)
    one = asked.groupBy("vec_id", "dim").agg(F.min("vector").alias("vector"))
    one = one.groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("q")).select("vec_id", "q.dim", "q.vector")
    questions = packed(one, "asked", asked_blocks).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dim", "part", F.col("ids").alias("query_ids"), F.col("rows").alias("query_rows"))
    dealt = [df.repartition(places, "dim", "part") for df in (table, questions)]
    meetings = dealt[0].join(dealt[1].hint("shuffle_hash"), ["dim", "part"])
    with arrow_batches(vectors.sparkSession, 1):
        found = settle(meetings.mapInPandas(_meet(k), _FOUND), "found")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

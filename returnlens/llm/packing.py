"""Sequence packing by multiway differencing.

Every document becomes its token ids and an end id. Whole windows are cut off its front; what remains is cut into pieces
of at most ``piece`` ids. A task gathers pieces for about ``windows`` windows and partitions them with the
Karmarkar-Karp differencing method: each piece starts as a partial partition of its own, and the two partial partitions
with the largest spread are merged with opposing imbalances, until one near-equal partition is left. If its largest window
exceeds the capacity, the window count rises and the pieces are partitioned anew.

Groups never leave their task, so packing needs no shuffle, and memory is bounded by one group, one batch and one slice of
texts (``tokens.py`` reads their ids).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnlens.llm.common import arrow_batches
from returnlens.llm.tokens import Tokens
from returnlens.session import settle

CAPACITY = 2048
END_ID = 1
BATCH = 500  # texts handed to Python at once
SLICE = 1 << 20  # bytes of text whose ids are found at once
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("sequence_id", T.LongType()),
    T.StructField("offset", T.LongType()),
])


def differencing(sizes: list[int], ways: int) -> list[list[int]]:
    """Split the indexes of ``sizes`` into ``ways`` parts with near-equal sums."""
    n = len(sizes)
    heap = [(-size, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    sums, merged = {}, []  # a piece's own sums are made when it is merged; how the ways met is kept in few bytes

    def taken(k: int) -> np.ndarray:
        if k >= n:
            return sums.pop(k)
        alone = np.zeros(ways, np.int64)
        alone[-1] = sizes[k]
        return alone

    kind = np.min_scalar_type(ways)
    for serial in range(n, 2 * n - 1):
        _, i = heapq.heappop(heap)
        _, j = heap[0]
        both = taken(i) + taken(j)[::-1]
        order = both.argsort(kind="stable")
        both = both[order]
        both -= both[0]
        sums[serial] = both
        heapq.heapreplace(heap, (-int(both[-1]), serial))
        merged.append((i, j, order.astype(kind)))
    parts = [[] for _ in range(ways)]
    places = {2 * n - 2: np.arange(ways, dtype=kind)}  # of a partial partition's ways among the parts
    final = [ways - 1] * n
    for serial in range(2 * n - 2, n - 1, -1):
        i, j, order = merged.pop()
        place = np.empty_like(order)
        place[order] = places.pop(serial)
        for k, way in ((i, place), (j, place[::-1])):
            if k >= n:
                places[k] = way
            else:
                final[k] = int(way[-1])
    for i, way in enumerate(final):
        parts[way].append(i)
    return parts


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Fewest near-equal windows that differencing can keep within the capacity."""
    if not sizes:
        return []
    ways = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = differencing(sizes, ways)
        if max(sum(sizes[i] for i in p) for p in parts) <= capacity:
            return [p for p in parts if p]
        ways += 1


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of a batch, by about ``SLICE`` bytes of text."""
    doc_ids, texts = batch.column(0), batch.column(1)
    at = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(texts)]
    for begin, end in zip(cuts, cuts[1:]):
        yield doc_ids[begin:end].to_pylist(), texts[begin:end]


def _packer(path: str, capacity: int, piece: int, windows: int):
    spare = 4 * windows  # what differencing may miss by, so that the planned number of windows nearly always holds

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(path, END_ID)  # for this task: what a worker keeps beyond it would weigh on later stages
        sequence = TaskContext.get().partitionId() << 33
        rows, waiting, mass = [], [], 0

        def flush():
            nonlocal sequence, waiting, mass
            for part in windows_of([w[2] for w in waiting], capacity):
                offset = 0
                for i in sorted(part):
                    doc_id, start, length, crc, total = waiting[i]
                    rows.append((doc_id, start, length, crc, total, sequence, offset))
                    offset += length
                sequence += 1
            waiting, mass = [], 0

        for doc_ids, texts in (part for batch in batches for part in _slices(batch)):
            flat, totals = tokens.ids(texts)
            left = memoryview(flat.view(np.uint8))
            for doc_id, total in zip(doc_ids, totals.tolist(), strict=True):
                ids, left = left[:4 * total], left[4 * total:]
                whole = total // capacity * capacity
                for start in range(0, whole, capacity):
                    rows.append((doc_id, start, capacity, zlib.crc32(ids[4 * start:4 * (start + capacity)]), total, sequence, 0))
                    sequence += 1
                for start in range(whole, total, piece):
                    length = min(piece, total - start)
                    if mass + length > windows * capacity - spare:
                        flush()
                    waiting.append((doc_id, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]), total))
                    mass += length
                if len(rows) >= 20_000:
                    yield _batch(rows)
                    rows = []
        flush()
        yield _batch(rows)
        pa.default_memory_pool().release_unused()  # else the worker holds it through later stages

    return pack


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(SCHEMA.names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], SCHEMA.names)


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, piece: int = 256, windows: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a path that every executor can open; by default the installed public word tokenizer. A null or empty
    text is the end id alone. Null and repeated ids and repeated rows are packed row by row, an empty table gives no rows,
    and other columns are not read. Sequence ids carry the task's number in their upper bits: unique, not gapless.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with arrow_batches(docs.sparkSession, BATCH):  # holds for what runs inside, so the pieces are written here
        return settle(base.mapInArrow(_packer(tokenizer, capacity, piece, windows), SCHEMA), "pieces")

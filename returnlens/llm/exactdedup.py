"""Exact duplicates through a minimal perfect hash over the digests seen before.

The rows fall into a history and what comes new. The distinct digests of the history are dealt into shards by their own
bytes. A task builds a minimal perfect hash for a shard: level by level every digest still unplaced is thrown into a bit
array, those that fall alone take their place, the rest go on to the next, smaller level. The rank of a digest's bit is its
slot, so n digests fill slots 0 to n - 1, and a slot holds the full digest, the locator of the row that stays and the number
of rows.

The distinct digests that come new meet the index of their shard. A perfect hash sends every key somewhere, so each lookup
compares all bytes with the slot's digest: equal ones are repeats and add to the slot, the others are grouped apart.

What a task holds is one shard, of a stated mean size; rows with one digest are reduced inside the map tasks first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnlens.llm.common import BROADCAST_ROWS, mix64, small
from returnlens.session import settle

SHARD_ROWS = 50_000  # mean number of digests in a shard
HEAVY = 1000  # at most so many groups are joined back by broadcast alone
LOAD = 2.0  # bits of a level for each digest thrown into it

_U = np.uint64
_INDEX = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("widths", T.ArrayType(T.LongType(), False)), T.StructField("bits", T.BinaryType()),
    T.StructField("digests", T.BinaryType()), T.StructField("locators", T.BinaryType()),
])
_GROUPS = T.StructType([
    T.StructField("digest", T.BinaryType()), T.StructField("unnamed", T.BooleanType()), T.StructField("id", T.LongType()),
    T.StructField("row", T.LongType()), T.StructField("size", T.LongType()),
])


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests, given as rows of four 64-bit words."""

    def __init__(self, widths: list[int], bits: np.ndarray):
        self.widths, self.bits = widths, bits
        self.starts = np.concatenate([[0], np.cumsum(widths)]).astype(np.int64)
        self.ranks = np.cumsum(bits, dtype=np.int64)

    @staticmethod
    def places(words: np.ndarray, level: int, width: int) -> np.ndarray:
        h = np.full(len(words), level + 1, _U) * _U(0x9E3779B97F4A7C15)
        for k in range(4):
            h = mix64(h + words[:, k])
        return (h % _U(width)).astype(np.int64)

    @classmethod
    def build(cls, words: np.ndarray) -> PerfectHash:
        widths, bits, left = [], [], words
        while len(left):
            width = max(64, int(LOAD * len(left)))
            at = cls.places(left, len(widths), width)
            alone = np.bincount(at, minlength=width) == 1
            widths.append(width)
            bits.append(alone)
            left = left[~alone[at]]
        return cls(widths, np.concatenate(bits) if bits else np.empty(0, bool))

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of every digest; -1 for what falls through all levels, which was not among the keys."""
        out, open_ = np.full(len(words), -1, np.int64), np.arange(len(words))
        for level, width in enumerate(self.widths):
            at = self.places(words[open_], level, width) + self.starts[level]
            hit = self.bits[at]
            out[open_[hit]] = self.ranks[at[hit]] - 1
            open_ = open_[~hit]
        return out

    def packed(self) -> bytes:
        return np.packbits(self.bits).tobytes()

    @classmethod
    def unpacked(cls, widths: list[int], packed: bytes) -> PerfectHash:
        return cls(list(widths), np.unpackbits(np.frombuffer(packed, np.uint8), count=sum(widths)).astype(bool))


def _words(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), _U).reshape(-1, 4)


def _numbers(rows: pd.DataFrame) -> np.ndarray:
    """unnamed, id, row and size as one row of numbers each; a missing id is held as 0."""
    return np.column_stack([rows["unnamed"].astype("int64"), rows["id"].astype("Int64").fillna(0).astype("int64"), rows["row"], rows["size"]])


def _index(rows: pd.DataFrame) -> pd.DataFrame:
    words = _words(rows["digest"])
    perfect = PerfectHash.build(words)
    slots = perfect.slots(words)
    digests, numbers = np.empty_like(words), np.empty((len(words), 4), np.int64)
    digests[slots], numbers[slots] = words, _numbers(rows)
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "widths": [perfect.widths], "bits": [perfect.packed()], "digests": [digests.tobytes()], "locators": [numbers.tobytes()]})


def _look_up(new: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """The shard's groups: every slot, with the repeats that came new counted in, and what was in no slot."""
    words = _words(new["digest"])
    fresh = _numbers(new)
    if len(index):
        held = index.iloc[0]
        digests = np.frombuffer(held["digests"], _U).reshape(-1, 4)
        numbers = np.frombuffer(held["locators"], np.int64).reshape(-1, 4).copy()
        slots = PerfectHash.unpacked(held["widths"], held["bits"]).slots(words)
        member = (slots >= 0) & (digests[slots] == words).all(axis=1)
        at, came = slots[member], fresh[member]
        numbers[at, 3] += came[:, 3]
        # Named rows come before unnamed ones, then smaller ids, then earlier rows.
        before = (came[:, 0] < numbers[at, 0]) | ((came[:, 0] == numbers[at, 0]) & ((came[:, 1] < numbers[at, 1]) | ((came[:, 1] == numbers[at, 1]) & (came[:, 2] < numbers[at, 2]))))
        numbers[at[before], :3] = came[before, :3]
        words, fresh = np.concatenate([digests, words[~member]]), np.concatenate([numbers, fresh[~member]])
    out = pd.DataFrame(fresh, columns=["unnamed", "id", "row", "size"])
    raw = words.tobytes()
    ids = out["id"].astype("Int64").mask(out["unnamed"] == 1)
    return out.assign(digest=[raw[i:i + 32] for i in range(0, len(raw), 32)], unnamed=out["unnamed"] == 1, id=ids)[_GROUPS.names]


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space each; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def groups(rows: DataFrame, seen: Column, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per distinct digest of ``rows`` (digest, id, row): digest, unnamed, id and row of the one that stays, size."""
    spark = rows.sparkSession
    shards = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard_rows))
    shard = F.pmod(F.xxhash64("digest"), F.lit(shards)).alias("shard")
    stays = F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "row")).alias("stays")

    def reduced(part: DataFrame) -> DataFrame:
        # The partial aggregate leaves one row a task and digest, so a digest of a third of all rows costs no more than another.
        return part.groupBy("digest").agg(stays, F.count(F.lit(1)).alias("size")).select(shard, "digest", "stays.*", "size")

    is_seen = F.coalesce(seen, F.lit(False))
    index = settle(reduced(rows.where(is_seen)).groupBy("shard").applyInPandas(_index, _INDEX), "index")
    new = reduced(rows.where(~is_seen))
    return settle(new.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_look_up, _GROUPS), "groups")


def dedup(docs: DataFrame, seen: Column, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = SHARD_ROWS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical with every run of ASCII white space as one space; a null text is empty. The row
    with the smallest id of a group stays; of several rows with that id, one stays. A null id comes after all others:
    where a group has no other, one of its rows stays and ``keep_id`` is null. ``seen``, over the columns of ``docs``,
    tells the rows of the history; null counts as new. It decides where a group is found, never the result. An empty table
    gives no rows, and other columns are not read.

    Groups of one row need no join. The rest are joined back by digest: groups above a thousandth of all rows by broadcast,
    as there are fewer than a thousand, and the others, none of which is large, by broadcast while they are at most
    ``broadcast_rows`` and else by a shuffle in which rows of the large ones are spread.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("hex"), seen.alias("seen"))
    rows = settle(base.select(F.monotonically_increasing_id().alias("row"), "id", F.unhex("hex").alias("digest"), "seen"), "digests")
    total = rows.count()
    found = groups(rows, F.col("seen"), shard_rows).where("size > 1").select("digest", F.col("id").alias("keep"), F.col("row").alias("stays"), "size")
    is_large = F.col("size") * HEAVY > total
    large = F.broadcast(found.where(is_large).select("digest", F.struct("keep", "stays", "size").alias("large")))
    usual = small(found.where(~is_large).select("digest", F.lit(0).alias("salt"), F.struct("keep", "stays", "size").alias("usual")), broadcast_rows)
    spread = F.when(F.col("large").isNotNull(), 1 + F.pmod("row", F.lit(1 << 20))).otherwise(0).cast("int")
    joined = rows.join(large, "digest", "left").withColumn("salt", spread).join(usual, ["digest", "salt"], "left")
    group = F.coalesce("large", "usual")
    return joined.select(
        F.col("id").alias("doc_id"), F.when(group.isNull(), F.col("id")).otherwise(group["keep"]).alias("keep_id"),
        F.coalesce(group["size"], F.lit(1).cast("long")).alias("group_size"), F.coalesce(group["stays"] == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )

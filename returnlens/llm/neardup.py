"""Near-duplicate documents by SetSketch.

Each distinct shingle set gets 512 one-byte registers: register i keeps the smallest of the exponential variates that the
set's shingles draw for it, truncated to the grid of the powers of ``BASE``. Registers of a union are the maxima of the
registers, and registers of similar sets agree about as often as the sets overlap. Eight registers make a band; sets that
agree on a band are candidates.

1. Documents with equal shingle sets become one class, before anything is paired. Classes, not ids, are linked: an id with
   several texts belongs to several classes, which count as linked.
2. In rounds, every class is compared with one centre: the most central class of one of its band buckets, the best first. So
   a large group yields a star, not all its pairs. Verified links are merged into components before the next round, and
   classes that have reached their centre's component ask for no more of it. Rounds end when they link little.
3. In buckets that still hold several components, classes of different components are compared with each other. Buckets of
   at most ``FEW`` classes pair directly, each pair in its first common band. The classes of larger ones, such as texts of
   one template, are split by their rarest shingles first: two sets that share as much as the similarity asks for share one
   early in the order of rarity of both, so what differs in all its rare shingles never meets. What is inside one
   component needs no further look, so no link between different components is lost.

A pair is verified in three steps: sizes and agreeing registers inside the join; joint likelihood of the similarity, given
both set sizes and the counts of smaller, equal and larger registers; and last the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnlens.llm.common import arrow_batches, mix64, small
from returnlens.llm.components import components
from returnlens.session import settle

REGISTERS = 512
ROWS = 8  # registers in a band: the bytes of one long
LONGS = REGISTERS // ROWS
BASE = 1.2
RATE = 20.0
MISS = 1e-6
BATCH = 1000  # texts handed to Python at once
SLOTS = 1 << 16  # counters of how common shingles are
FEW = 64  # classes of a bucket that are paired with each other without a further split
FRUITFUL = 0.1  # links a pair of a round below which no further round of stars follows

_U = np.uint64
_SETS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("mark", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("sketch", T.ArrayType(T.LongType(), False)),
])


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct hashed shingles of a text, sorted."""
    # bytes.lower() changes A-Z only, and bytes.split() splits at \x20 and \x09-\x0D only.
    words = text.encode().lower().split() if isinstance(text, str) else []
    if not words:
        return np.empty(0, _U)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), _U, len(words))
    width = min(size, len(h))
    total = np.full(len(h) - width + 1, width, _U)
    for k in range(width):
        total = mix64(total + h[k:len(h) - width + 1 + k])
    return np.unique(total)


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """One row of register bytes for each set of hashed shingles; sets are not empty.

    A shingle draws points of a Poisson process, each for a random register; it stops once its next point lies above the
    largest register minimum of its set. That takes about n + m ln m draws for n shingles and m registers.
    """
    count = len(sets)
    least = np.full(count * REGISTERS, np.inf)
    own = np.repeat(np.arange(count), [len(s) for s in sets])
    seed = np.concatenate(sets) if count else np.empty(0, _U)
    at, drawn = np.zeros(len(seed)), 0
    while len(seed):
        steps = int(np.clip(60_000 // len(seed), 1, 64))
        turns = (np.arange(drawn + 1, drawn + steps + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))[None, :]
        bits = mix64(seed[:, None] + turns)
        gaps = -np.log(((bits >> _U(11)) + _U(1)).astype(float) * 2.0**-53) / (RATE * REGISTERS)
        points = at[:, None] + np.cumsum(gaps, axis=1)
        slot = own[:, None] * REGISTERS + (bits & _U(REGISTERS - 1)).astype(np.int64)
        np.minimum.at(least, slot.ravel(), points.ravel())
        at, drawn = points[:, -1], drawn + steps
        open_ = at < least.reshape(count, REGISTERS).max(axis=1)[own]
        seed, own, at = seed[open_], own[open_], at[open_]
    return np.clip(np.floor(1 - np.log(least) / math.log(BASE)), 0, 255).astype(np.uint8).reshape(count, REGISTERS)


def _differ(x: np.ndarray | float) -> np.ndarray | float:
    """Probability that one register exceeds the other, from the share of the union's mass only the one set has."""
    return -np.log(1 - x * (BASE - 1) / BASE) / math.log(BASE)


def agreement(similarity: float) -> float:
    """Probability that registers of two equally large sets of this similarity agree."""
    return float(1 - 2 * _differ((1 - similarity) / 2))


def bands_for(similarity: float) -> int:
    """Bands that miss a pair of this similarity with a probability of at most ``MISS``; all 64 where that needs more."""
    return min(LONGS, math.ceil(math.log(MISS) / math.log(1 - agreement(similarity) ** ROWS)))


def least_agreeing(similarity: float) -> int:
    """Agreeing registers that a pair of this similarity falls short of with a probability of at most a tenth of ``MISS``.

    Registers agree least often where one set holds the other.
    """
    p, tail, least = float(1 - _differ(1 - similarity)), 0.0, 0
    while least < REGISTERS:
        tail += math.comb(REGISTERS, least) * p**least * (1 - p) ** (REGISTERS - least)
        if tail > MISS / 10:
            break
        least += 1
    return least


def may_reach(a: np.ndarray, b: np.ndarray, na: int, nb: int, similarity: float, slack: float = 12.5) -> bool:
    """Joint likelihood test: is ``similarity`` or more within reach of what the registers of both sets show?"""
    more, less = int((a > b).sum()), int((a < b).sum())
    j = np.append(np.linspace(0.0, min(na, nb) / max(na, nb), 101), similarity)
    u, v = na / (na + nb), nb / (na + nb)
    p, q = np.clip(_differ(u - v * j), 1e-9, 1), np.clip(_differ(v - u * j), 1e-9, 1)
    like = more * np.log(p) + less * np.log(q) + (REGISTERS - more - less) * np.log(np.clip(1 - p - q, 1e-9, 1))
    best = int(np.argmax(like))
    return bool(j[best] >= similarity or like[best] - like[-1] <= slack)


def _sketches(shingle: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held, first, mass = [], 0, 0
            for at, text in enumerate(batch["text"]):
                held.append(shingles(text, shingle))
                mass += len(held[-1])
                if mass > 200_000 or len(held) >= 1000:
                    yield _rows(batch.iloc[first:at + 1], held)
                    held, first, mass = [], at + 1, 0
            if held:
                yield _rows(batch.iloc[first:], held)

    return run


def _rows(batch: pd.DataFrame, held: list[np.ndarray]) -> pd.DataFrame:
    full = [i for i, s in enumerate(held) if len(s)]
    packed = sketch([held[i] for i in full]).view(np.int64)
    out: list = [[]] * len(held)
    for k, i in enumerate(full):
        out[i] = packed[k]
    d1 = [int(np.bitwise_xor.reduce(mix64(s))) if len(s) else 0 for s in held]
    d2 = [int(mix64(s + _U(1)).sum(dtype=_U)) if len(s) else 0 for s in held]
    signed = lambda x: np.array(x, _U).view(np.int64)
    return pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").array, "mark": batch["mark"].array, "n": [len(s) for s in held], "d1": signed(d1), "d2": signed(d2), "sketch": pd.Series(out, dtype=object)})


def _agree(a: Column, b: Column) -> Column:
    """How many of the registers packed in two arrays of longs are equal: bytes of the differences without a set bit."""

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        d = d.bitwiseOR(F.shiftrightunsigned(d, 4)).bitwiseAND(F.lit(0x0F0F0F0F0F0F0F0F))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(F.lit(0x0303030303030303))
        return F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(REGISTERS) - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda acc, x: acc + x)


def _counted(shingle: int):
    """(slot, times): how many shingles of the texts fall into each of ``SLOTS`` counters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                times += np.bincount((shingles(text, shingle) % _U(SLOTS)).astype(np.int64), minlength=SLOTS)
        slot = np.flatnonzero(times)
        if len(slot):
            yield pd.DataFrame({"slot": slot, "times": times[slot]})

    return run


def _rarest(shingle: int, percent: int, times: np.ndarray):
    """(id, component, n, h, place) for the shingles of each text that come first by counter, then by value."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, component, text in zip(batch["id"], batch["component"], batch["text"], strict=True):
                own = shingles(text, shingle)
                n = len(own)
                h = own[np.argsort(times[(own % _U(SLOTS)).astype(np.int64)], kind="stable")][:(100 - percent) * n // 100 + 1]
                yield pd.DataFrame({"id": i, "component": component, "n": n, "h": h.view(np.int64), "place": np.arange(1, len(h) + 1)})

    return run


def _verifier(shingle: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        @lru_cache(64)
        def full(text: str) -> np.ndarray:
            return shingles(text, shingle)

        for batch in batches:
            keep = []
            for a, b, sa, sb, na, nb in zip(batch["text_a"], batch["text_b"], batch["sketch_a"], batch["sketch_b"], batch["n_a"], batch["n_b"], strict=True):
                ra, rb = np.asarray(sa, np.int64).view(np.uint8), np.asarray(sb, np.int64).view(np.uint8)
                linked = may_reach(ra, rb, na, nb, percent / 100)
                if linked:
                    x, y = full(a), full(b)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    linked = 100 * common >= percent * (len(x) + len(y) - common)
                keep.append(linked)
            yield batch.loc[keep, ["a", "b"]]

    return run


def _named(df: DataFrame, end: str) -> DataFrame:
    return df.select(*[F.col(c).alias(end if c == "id" else f"{c}_{end}") for c in df.columns])


class _Linker:
    """Candidate pairs of classes, verified; components so far as a table (id, component) of classes with a link."""

    def __init__(self, base: DataFrame, sides: DataFrame, shingle: int, percent: int):
        """``base``: doc_id, mark, text; ``sides``: id, n, sketch and the row (doc_id, mark) that shows the class's text."""
        self.spark, self.shingle, self.percent = base.sparkSession, shingle, percent
        self.floor = least_agreeing(percent / 100)
        self.sides = sides.select("id", "n", "sketch")
        rows = sides.select("id", F.col("doc_id").alias("of"), F.col("mark").alias("marked"))
        shown = base.join(rows, (base["doc_id"] == rows["of"]) & (base["mark"] == rows["marked"])).select("id", "text")
        self.texts = settle(shown.dropDuplicates(["id"]).join(self.sides, "id"), "texts")
        self._set(self.spark.createDataFrame([], "id long, component long"))

    def near(self, x: str, y: str) -> Column:
        sizes = 100 * F.least(f"n_{x}", f"n_{y}") >= self.percent * F.greatest(f"n_{x}", f"n_{y}")
        return sizes & (_agree(F.col(f"sketch_{x}"), F.col(f"sketch_{y}")) >= self.floor)

    def _set(self, labels: DataFrame) -> None:
        self.labels, self.looked_up = labels, small(labels)  # counted once for all joins with it

    def labelled(self, df: DataFrame, column: str, name: str) -> DataFrame:
        labels = self.looked_up.select(F.col("id").alias(column), F.col("component").alias(name))
        return df.join(labels, column, "left").withColumn(name, F.coalesce(name, column))

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        both = pairs.select("a", "b").join(_named(self.texts, "a"), "a").join(_named(self.texts, "b"), "b")
        with arrow_batches(self.spark, BATCH):
            return settle(both.mapInPandas(_verifier(self.shingle, self.percent), "a long, b long"), "links")

    def merge(self, links: DataFrame) -> None:
        """Merge the components of both ends of every link."""
        between = self.labelled(self.labelled(links.select("a", "b"), "a", "x"), "b", "y").where("x <> y")
        tops = components(between.select(F.col("x").alias("a"), F.col("y").alias("b")))
        tops = tops.select(F.col("id").alias("component"), F.col("component").alias("top"))
        moved = self.labels.join(tops, "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        # A component is named by one of its classes; those that were alone until now have no label yet.
        fresh = tops.select(F.col("component").alias("id"), F.col("top").alias("component")).join(self.labels.select("id"), "id", "left_anti")
        self._set(settle(moved.union(fresh), "labels"))


def _stars(rows: DataFrame) -> DataFrame:
    """(id, centre, turn): the distinct centres of each class's buckets, the most central first."""
    weight = rows.groupBy("id").agg(F.sum("size").alias("weight"))
    rows = rows.join(weight, "id").select("id", "bucket", "weight")
    centre = rows.groupBy("bucket").agg(F.max(F.struct("weight", "id")).alias("centre"))
    met = rows.select("id", "bucket").join(centre, "bucket").where(F.col("id") != F.col("centre.id")).select("id", "centre").distinct()
    # A class lies in one bucket a band, so this window holds at most as many rows as there are bands.
    return met.select("id", F.col("centre.id").alias("centre"), F.row_number().over(Window.partitionBy("id").orderBy(F.desc("centre"))).alias("turn"))


def rounds(linker: _Linker, rows: DataFrame) -> list[tuple[int, int]]:
    """Link each class to one centre a round; (pairs compared, links found) of every round."""
    stars = settle(_stars(rows), "stars")
    done: list[tuple[int, int]] = []
    while True:
        turn = len(done) + 1
        pairs = linker.labelled(linker.labelled(stars.where(F.col("turn") == turn), "id", "x"), "centre", "y").where("x <> y")
        pairs = pairs.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
        pairs = settle(pairs.join(_named(linker.sides, "a"), "a").join(_named(linker.sides, "b"), "b").where(linker.near("a", "b")).select("a", "b"), "pairs")
        compared = pairs.count()
        links = linker.verify(pairs) if compared else pairs
        found = links.count() if compared else 0
        done.append((compared, found))
        if found:
            linker.merge(links)
        if found < FRUITFUL * compared or not compared:
            return done


def crossing(linker: _Linker, rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and pass the tests of sizes and registers."""
    labelled = linker.labelled(rows.select("id", "band", "bucket"), "id", "component")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("members")).where("low < high").select("bucket", "members")
    left = settle(labelled.join(mixed, "bucket").select("id", "band", "bucket", "component", "members"), "mixed")
    few = left.where(F.col("members") <= FEW).select("id", "band", "bucket", "component").join(linker.sides, "id")
    a = few.select(*[F.col(c).alias(f"{c}_a") for c in few.columns])
    b = few.select(*[F.col(c).alias(f"{c}_b") for c in few.columns])
    once = F.array_position(F.zip_with("sketch_a", "sketch_b", lambda x, y: x == y), True) == F.greatest("band_a", "band_b") + 1
    meet = (F.col("bucket_a") == F.col("bucket_b")) & (F.col("component_a") < F.col("component_b"))
    direct = a.join(b, meet & linker.near("a", "b") & once).select("id_a", "id_b")

    many = left.where(F.col("members") > FEW).select("id", "component").distinct()
    asked = settle(many.join(linker.texts.select("id", "text"), "id"), "asked")
    with arrow_batches(linker.spark, BATCH):
        # Any order that is the same for all sets loses nothing; counters of a fixed number are enough to put what is common last.
        counted = asked.mapInPandas(_counted(linker.shingle), "slot long, times long").groupBy("slot").agg(F.sum("times").alias("times")).collect()
        times = np.zeros(SLOTS, np.int64)
        times[[r["slot"] for r in counted]] = [r["times"] for r in counted]
        rare = settle(asked.mapInPandas(_rarest(linker.shingle, linker.percent, times), "id long, component long, n long, h long, place long"), "rare")
    meeting = rare.groupBy("h").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("h")
    rare = rare.join(meeting, "h", "left_semi")
    a = rare.select(*[F.col(c).alias(f"{c}_a") for c in rare.columns])
    b = rare.select(*[F.col(c).alias(f"{c}_b") for c in rare.columns])

    def first_common(x: str) -> Column:
        # What two sets of these sizes must share does not fit behind a first common shingle at a later place.
        return linker.percent * (F.col("n_a") + F.col("n_b")) <= (100 + linker.percent) * (F.col(f"n_{x}") - F.col(f"place_{x}") + 1)

    meet = (F.col("h_a") == F.col("h_b")) & (F.col("component_a") < F.col("component_b"))
    split = a.join(b, meet & first_common("a") & first_common("b")).select("id_a", "id_b").distinct()
    split = split.join(linker.sides.select(*[F.col(c).alias(f"{c}_a") for c in linker.sides.columns]), "id_a")
    split = split.join(linker.sides.select(*[F.col(c).alias(f"{c}_b") for c in linker.sides.columns]), "id_b").where(linker.near("a", "b")).select("id_a", "id_b")
    return settle(direct.union(split).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct(), "pairs")


def classes(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Documents whose distinct word shingles overlap by ``percent`` of their union are linked; a component is what links
    reach. Words are cut at ASCII white space after A-Z are lower-cased; a shorter text is one shingle. A null or blank
    text has no shingles and is linked with nothing (a row without shingles that shares its id with others keeps its own
    component), and so is a row with a null id (its component is null, it is kept). Rows with the same id and different
    texts count as linked, and what is near either text joins them. An empty table gives no rows, and other columns are
    not read. Shingles are compared as 64-bit hashes.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    with arrow_batches(docs.sparkSession, BATCH):
        sets = settle(base.mapInPandas(_sketches(shingle), _SETS), "sets")
    own = sets.where("n > 0 and doc_id is not null")
    key = ["n", "d1", "d2"]
    # Equal sets have equal sketches, so any will do. The number of a class is fixed by writing it.
    reps = own.groupBy(*key).agg(F.min(F.struct("doc_id", "mark")).alias("row"), F.first("sketch").alias("sketch"))
    reps = settle(reps.select(F.monotonically_increasing_id().alias("id"), *key, "row.doc_id", "row.mark", "sketch"), "classes")
    rows = reps.select("id", F.posexplode(F.slice("sketch", 1, bands_for(percent / 100))).alias("band", "value")).select("id", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = settle(rows.join(shared, "bucket"), "buckets")
    involved = small(rows.select("id").distinct())
    linker = _Linker(base.where("doc_id is not null"), reps.join(involved, "id", "left_semi"), shingle, percent)

    # Ids with several texts: each of their classes is tied to the first of them.
    spread = own.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("first"), F.max(F.struct(*key)).alias("last")).where("first <> last").select("doc_id", "first")
    several = own.join(small(spread), "doc_id").select(*key, "first").distinct()
    ids = reps.select("id", *key)
    ends = several.join(ids, key).select(F.col("id").alias("a"), F.col("first.n").alias("n"), F.col("first.d1").alias("d1"), F.col("first.d2").alias("d2"))
    tied = settle(ends.join(ids, key).select("a", F.col("id").alias("b")).where("a <> b"), "tied")
    if not tied.isEmpty():
        linker.merge(tied)
    rounds(linker, rows)
    linker.merge(linker.verify(crossing(linker, rows)))

    # Every class with the smallest id it reaches.
    placed = linker.labelled(reps.select("id", *key, "doc_id"), "id", "component")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    reach = placed.join(small(least), "component").select(*key, "component_id")
    out = sets.select("doc_id", *key).join(reach, key, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity with it, so the signatures of the two cannot be compared
slot by slot. Containment is instead searched from the item's side: the minimum of an item under a random order of its
shingles lies in a document with a probability equal to the share of the item that the document holds. Items are
partitioned by size; every partition has its own number of orders and its own number of minima that a document must hold,
set so that an item at the threshold is missed with a probability below 1e-6. Looking minima up in the documents' shingle
sets is one hash join whose small side is bounded by the number of items times the longest signature.

Candidates are verified with the shingles themselves. Everything is built-in functions.
"""

from __future__ import annotations

import string
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from returnlens.llm.common import small
from returnlens.session import settle

#: Orders for items of at least so many shingles. Larger items need more, as a fixed share of them may be missing anywhere.
PARTITIONS = [(1, 16), (32, 24), (128, 32), (512, 48)]
MISS = 1e-6


def needed(orders: int, share: float) -> int:
    """Most minima that may be asked for, so that an item of which ``share`` is present is rarely missed."""
    tail, least = 0.0, 0
    while least < orders:
        tail += comb(orders, least) * share**least * (1 - share) ** (orders - least)
        if tail > MISS:
            break
        least += 1
    return max(1, least)


def words(text: Column) -> Column:
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingles(found: Column, size: int, hashed: bool) -> Column:
    """Distinct runs of ``size`` words, or the whole sequence if it is shorter; none without words."""
    last = F.greatest(F.size(found) - size, F.lit(0))
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(found, i + 1, size)) if hashed else F.array_join(F.slice(found, i + 1, size), " "))
    return F.when(F.size(found) > 0, F.array_distinct(each))


def spans(found: Column, widths: list[int], hashed: bool) -> Column:
    """Distinct shingles of all these widths."""
    return F.array_distinct(F.concat(*[shingles(found, w, hashed) for w in widths]))


def contaminated(docs: DataFrame, items: DataFrame, size: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment) of every pair in which a document holds ``share`` of an item's shingles.

    Words are cut at ASCII white space after A-Z are lower-cased; an item with fewer words is one shingle, which is looked for
    in documents of any length; a null or blank text has none and pairs with nothing. Rows with a null id are not reported.
    Every item row is an item of its own. Repeated ids: a pair is reported once, for the row of the document and the row
    of the item with the largest containment. Empty tables give no rows, and other columns are not read. Whole texts are
    searched.
    """
    item = items.select(F.col(item_col).alias("item_id"), words(F.col(item_text_col)).alias("w")).where("item_id is not null and size(w) > 0").distinct()
    item = item.select(F.monotonically_increasing_id().alias("item"), "item_id", F.least(F.size("w"), F.lit(size)).alias("width"), shingles(F.col("w"), size, False).alias("all"))
    item = settle(item.select("item", "item_id", "width", F.size("all").alias("n_item"), F.explode("all").alias("shingle")), "items")
    widths = sorted({size} | {r["width"] for r in item.select("width").distinct().collect()})
    orders = least = F.lit(0)
    for smallest, count in PARTITIONS:
        inside = F.col("n_item") >= smallest
        orders, least = F.when(inside, count).otherwise(orders), F.when(inside, needed(count, share)).otherwise(least)
    hashed = F.xxhash64(F.split("shingle", " "))
    turns = item.select("item", "n_item", hashed.alias("h"), F.explode(F.sequence(F.lit(1), orders)).alias("turn"))
    minima = turns.groupBy("item", "n_item", "turn").agg(F.min_by("h", F.xxhash64("h", "turn")).alias("h"))
    signature = minima.groupBy("item", "n_item", "h").agg(F.bit_or(F.expr("shiftleft(1L, turn)")).alias("mask"))
    signature = signature.select("item", least.alias("least"), "h", "mask")
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    held = text.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.explode(spans(F.col("w"), widths, True)).alias("h"))
    hits = held.join(small(signature), "h").groupBy("doc_id", "item", "least").agg(F.bit_or("mask").alias("mask"))
    candidates = settle(hits.where(F.bit_count("mask") >= F.col("least")).select("doc_id", "item"), "candidates")
    suspects = text.join(small(candidates.select("doc_id").distinct()), "doc_id", "left_semi")
    full = suspects.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    full = full.select("doc_id", "row", F.explode(spans(F.col("w"), widths, False)).alias("shingle"))
    common = full.join(small(item), "shingle").groupBy("doc_id", "row", "item", "item_id", "n_item").agg(F.count(F.lit(1)).alias("n_common"))
    exact = common.where(F.col("n_common") >= share * F.col("n_item") - 1e-9).join(small(candidates), ["doc_id", "item"], "left_semi")
    best = exact.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_common") / F.col("n_item")).alias("containment"), "n_item", "n_common")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_item", "best.n_common", "best.containment")

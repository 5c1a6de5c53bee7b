"""Language identification by rank-order profiles.

A profile lists the most frequent 1- to 3-grams of letters of a language, by rank. A document's own ranked n-grams are
compared with each profile by the out-of-place distance: how far each n-gram stands from its place in the profile, or the
profile's length where it is missing. The nearest profile wins.

Counting for the profiles is spread over the training rows and summed by (language, n-gram); only the profiles, of a stated
length each, reach the driver. Prediction is a map over the rows without a shuffle.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnlens.llm.common import arrow_batches, in_sample, sample_fraction

UNKNOWN = "und"
HELD = 500_000  # n-grams of a language that a task holds before it counts them
BATCH = 500  # texts handed to Python at once
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_COUNTS = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("times", T.LongType())])


def grams(text: str) -> np.ndarray | None:
    """Every 1- to 3-gram of the words of a text, as one number each; None if the text has no letter."""
    words = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):
        return None
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), dtype="<u4").astype(np.int64)
    pairs = (c[:-1] << 21) | c[1:]
    inside = c[1:-1] != 32  # a space stands only at the ends of an n-gram
    return np.concatenate([c[1:-1][inside], pairs, ((pairs[:-1] << 21) | c[2:])[inside]])


def ranked(keys: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent keys, most frequent first; ties by key."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    order = np.argsort(-counts, kind="stable")[:top]
    return keys[first][order]


class Profiles:
    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        """``rows``: (language, n-gram, rank from 0)."""
        self.top, self.langs = top, sorted({r[0] for r in rows})
        self.keys = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.keys)), -1, np.int64)
        for lang, key, rank in rows:
            self.ranks[self.langs.index(lang), np.searchsorted(self.keys, key)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        found = grams(text) if isinstance(text, str) and self.langs else None
        if found is None:
            return UNKNOWN, 0.0
        mine = ranked(found, self.top)
        at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
        place = np.where(self.keys[at] == mine, self.ranks[:, at], -1)
        far = np.where(place >= 0, np.abs(place - np.arange(len(mine))), self.top).sum(axis=1)
        best = int(np.argmin(far))
        if len(far) == 1:
            return self.langs[0], float(1 - far[0] / (self.top * len(mine)))
        second = int(np.partition(far, 1)[1])
        return self.langs[best], float(second / (second + far[best])) if second else 0.5


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def counted(lang: str, found: list[np.ndarray]) -> pd.DataFrame:
        keys, times = np.unique(np.concatenate(found), return_counts=True)
        return pd.DataFrame({"lang": lang, "gram": keys, "times": times})

    for batch in batches:
        parts, held = defaultdict(list), defaultdict(int)
        for lang, text in zip(batch["lang"], batch["text"], strict=True):
            found = grams(text)
            if found is None:
                continue
            parts[lang].append(found)
            held[lang] += len(found)
            if held[lang] > HELD:  # by mass, so a batch of long texts holds no more than one of short ones
                yield counted(lang, parts.pop(lang))
                held[lang] = 0
        for lang, found in parts.items():
            yield counted(lang, found)


def train(docs: DataFrame, usable: Column, top: int = 400, max_docs_per_lang: int = 4000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Profiles of the rows where ``usable`` holds; at most about ``max_docs_per_lang`` rows a language, chosen by hash of the id.

    Rows where ``usable``, the text or the language is null teach nothing, and neither do texts without a letter. Rows with
    one id, a null one included, are taken or left together; repeated rows count as often as they are there. An empty table
    gives profiles that answer ``und``.
    """
    rows = docs.where(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Profiles([], top)
    share = F.lit(0.0)
    for lang, count in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, sample_fraction(count, max_docs_per_lang)).otherwise(share)
    sample = rows.where(in_sample(F.col("id"), share)).select("lang", "text")
    totals = sample.mapInPandas(_count, _COUNTS).groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    w = Window.partitionBy("lang").orderBy(F.desc("times"), "gram")
    best = totals.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < top)
    with arrow_batches(docs.sparkSession, BATCH):
        return Profiles([(r["lang"], r["gram"], r["rank"]) for r in best.collect()], top)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned. Otherwise the score is the second
    distance over the sum of the two smallest: 0.5 for a tie, which goes to the first language by name, nearer 1 the
    clearer. Whole texts are read, repeated rows and null ids stay as they are, an empty table gives no rows, and other
    columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [profiles.predict(t) for t in batch["text"]]
            ids = batch["doc_id"].astype("Int64") if isinstance(schema[0].dataType, (T.LongType, T.IntegerType)) else batch["doc_id"]
            yield pd.DataFrame({"doc_id": ids, "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(label, schema)


def keep_identified(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text gets a language, with all their columns.

    Drops null texts, texts without a letter, and every row if nothing was learned. Only texts go to Python, and a flag comes
    back for each, so ids need not be unique or present. They go by the hundred: Arrow would hold ten thousand whole rows
    outside the heap, twice.
    """
    identified = F.udf(lambda text: profiles.predict(text)[0] != UNKNOWN, T.BooleanType(), useArrow=False)
    return docs.where(identified(F.col(text_col)))

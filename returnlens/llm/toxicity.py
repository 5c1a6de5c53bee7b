"""Toxicity by weak supervision.

1. Words and word beginnings that stand out in toxic training rows become lexicon voters; shouting, exclamation and
   absence of every lexicon entry are pattern voters.
2. A generative label model estimates, starting from the training labels, how often each voter is right, and how far voters
   repeat each other within a class; correlated voters share their weight.
3. A linear classifier is fitted to the posterior labels and scores every document.

Statistics for step 1 are counted over all labelled rows, where the rows are, and every entry that passes the test on its
gain is kept: features of a text with many copies pass as well, and none of them takes another's place. The fit sees a
documented, bounded sample of labelled rows, in which every entry has some of its rows; scoring is a map over all rows
without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from returnlens.llm.common import sample_fraction, small
from returnlens.session import settle

_WORDS = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b")
_EXCLAIM = re.compile(r"!{2,}")
PREFIXES = (4, 5, 6, 7)
PATTERNS = 3
#: Log likelihood that a lexicon entry must gain over chance, about the logarithm of how many entries are tried.
MIN_GAIN = 12.0
#: About so many rows of every lexicon entry are in the sample of the fit, or all where there are fewer.
ENTRY_ROWS = 20
_DF = T.StructType([T.StructField("feature", T.StringType()), T.StructField("toxic_docs", T.LongType()), T.StructField("clean_docs", T.LongType())])
_HITS = T.StructType([T.StructField("toxic", T.IntegerType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("patterns", T.ArrayType(T.IntegerType())), T.StructField("chance", T.DoubleType())])


def features(word: str) -> list[str]:
    return [word + "$"] + [word[:n] for n in PREFIXES if len(word) > n]


def patterns(text: str) -> list[int]:
    """Shouting; exclamation."""
    return [int(_SHOUT.search(text) is not None), int(_EXCLAIM.search(text) is not None)]


class Lexicon:
    """Which chosen features a text has; remembers a bounded number of words."""

    def __init__(self, names: list[str], limit: int = 500_000):
        self.at, self.limit, self.known = {f: i for i, f in enumerate(names)}, limit, {}

    def __getstate__(self):
        return {"at": self.at, "limit": self.limit, "known": {}}

    def hits(self, text: str) -> set[int]:
        known, found = self.known, set()
        if len(known) > self.limit:
            known.clear()
        for word in set(_WORDS.findall(text.lower())):
            got = known.get(word)
            if got is None:
                got = known[word] = tuple(self.at[f] for f in features(word) if f in self.at)
            if got:
                found.update(got)
        return found


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    correlations: Correlations | None

    def score(self, text: str | None) -> float:
        total = self.bias + sum(self.weights[i] for i in self.lexicon.hits(text)) if isinstance(text, str) else self.bias
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -30, 30))))


def _document_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
            own = set()
            for word in set(_WORDS.findall(text.lower())):
                own.update(features(word))
            counts[1 - int(toxic)].update(own)
        if len(counts[0]) + len(counts[1]) > 1_000_000:
            yield from _counted(counts)
            counts = Counter(), Counter()
    yield from _counted(counts)


def _counted(counts: tuple[Counter, Counter], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    names = list(counts[0].keys() | counts[1].keys())
    for at in range(0, len(names), rows):
        part = names[at:at + rows]
        yield pd.DataFrame({"feature": np.array(part, object), "toxic_docs": [counts[0][n] for n in part], "clean_docs": [counts[1][n] for n in part]})


class Sparse:
    """A matrix of zeros and ones by the places of its ones; its size follows the ones, not the columns."""

    def __init__(self, hits: list[list[int]], size: int):
        self.shape = len(hits), size
        self.row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
        self.col = np.fromiter((i for h in hits for i in h), np.int64, len(self.row))
        self.fired = np.bincount(self.col, minlength=size)

    def times(self, v: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, v[self.col], self.shape[0])

    def back(self, u: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, u[self.row], self.shape[1])


class Correlations:
    """Correlations of voters inside the classes, worked out where they are asked for; the whole square is never held."""

    def __init__(self, votes: Sparse, q: np.ndarray):
        self.votes, self.q = votes, q
        by_toxic, by_clean = votes.back(q), votes.back(1 - q)
        self.toxic, self.clean = by_toxic / (q.sum() + 1e-9), by_clean / ((1 - q).sum() + 1e-9)
        cross = self.toxic * by_toxic + self.clean * by_clean
        square = votes.fired - 2 * cross + self.toxic**2 * (q @ q) + 2 * self.toxic * self.clean * (q @ (1 - q)) + self.clean**2 * ((1 - q) @ (1 - q))
        self.square = np.maximum(square, 0) / votes.shape[0]
        self.spread = np.sqrt(self.square) + 1e-6

    def left(self, voters: np.ndarray) -> np.ndarray:
        """What the class does not tell of these voters' votes, over their spread."""
        place = np.full(self.votes.shape[1], -1)
        place[voters] = np.arange(len(voters))
        at = place[self.votes.col]
        x = np.zeros((self.votes.shape[0], len(voters)), np.float32)
        x[self.votes.row[at >= 0], at[at >= 0]] = 1
        x -= np.outer(self.q, self.toxic[voters]).astype(np.float32) + np.outer(1 - self.q, self.clean[voters]).astype(np.float32)
        return x / (self.spread[voters] * math.sqrt(self.votes.shape[0])).astype(np.float32)

    def __getitem__(self, pair: tuple[int, int]) -> float:
        x = self.left(np.array(sorted(set(pair))))
        return float(x[:, 0] @ x[:, -1])

    def crowding(self, sides: np.ndarray, near: float = 0.8, block: int = 1024) -> np.ndarray:
        """Sum of each voter's near-complete correlations with the others of its side.

        Voters that fire in the same rows are alike to all others, so one of them is compared for all.
        """
        rng = np.random.default_rng(0)
        marks = np.stack([sides, self.votes.back(rng.random(self.votes.shape[0])), self.votes.back(rng.random(self.votes.shape[0]))], axis=1)
        _, first, of, many = np.unique(marks, axis=0, return_index=True, return_inverse=True, return_counts=True)
        of = of.ravel()
        total = np.zeros(len(first))
        for i in range(0, len(first), block):
            x = self.left(first[i:i + block])
            for j in range(i, len(first), block):
                close = np.clip(x.T @ self.left(first[j:j + block]), 0, 1)
                close[(close <= near) | (sides[first[i:i + block], None] != sides[None, first[j:j + block]])] = 0
                if i == j:
                    np.fill_diagonal(close, 0)
                else:
                    total[j:j + block] += many[i:i + block] @ close
                total[i:i + block] += close @ many[j:j + block]
        own = self.square[first] / self.spread[first] ** 2
        return (total + np.where(own > near, (many - 1) * own, 0))[of]


def label_model(votes: Sparse | np.ndarray, sides: np.ndarray, prior: float, right: np.ndarray, wrong: np.ndarray, rounds: int = 30, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, Correlations]:
    """Posterior of the toxic class, accuracies, correlations.

    ``votes`` tells which voter fires where, ``sides`` which class it then votes for; a voter that does not fire abstains.
    Expectation maximisation over the latent class, one accuracy a voter, with ``right`` and ``wrong`` as counts known
    beforehand; ``weights`` tells how many rows each row stands for. A voter moves the odds by how far its accuracy lies above the class's own share. Voters that go together
    inside the classes tell one thing: the evidence of each is divided by one plus the sum of its near-complete
    correlations.
    """
    if not isinstance(votes, Sparse):
        votes = Sparse([np.flatnonzero(v).tolist() for v in votes], votes.shape[1])
    weights = np.ones(votes.shape[0]) if weights is None else weights
    share, fired = np.ones(votes.shape[1]), votes.back(weights)
    accuracy = (right + 0.5) / (right + wrong + 1.0)
    base = np.log(prior / (1 - prior))
    q = np.zeros(votes.shape[0])
    for step in range(rounds):
        odds = np.log(accuracy / (1 - accuracy))
        evidence = share * np.where(sides == 1, np.maximum(odds - base, 0), -np.maximum(odds + base, 0))
        q = 1.0 / (1.0 + np.exp(-np.clip(base + votes.times(evidence), -30, 30)))
        agreed = np.where(sides == 1, votes.back(weights * q), votes.back(weights * (1 - q)))
        accuracy = np.clip((agreed + right + 0.5) / (fired + right + wrong + 1.0), 0.01, 0.99)
        if step % 10 == 9:
            share = 1.0 / (1.0 + Correlations(votes, q).crowding(sides))
    return q, accuracy, Correlations(votes, q)


def _solve(product: Callable[[np.ndarray], np.ndarray], diagonal: np.ndarray, goal: np.ndarray, accuracy: float = 1e-8) -> np.ndarray:
    """Conjugate gradients for a positive definite matrix known by its products and its diagonal."""
    w, left = np.zeros(len(goal)), goal.copy()
    z = left / diagonal
    way, now = z.copy(), left @ z
    first = now
    for _ in range(10 * len(goal)):
        if now <= accuracy**2 * first or now == 0:
            break
        ahead = product(way)
        length = now / (way @ ahead)
        w, left = w + length * way, left - length * ahead
        z = left / diagonal
        last, now = now, left @ z
        way = z + now / last * way
    return w


def linear(hits: list[list[int]], size: int, target: np.ndarray, importance: np.ndarray, steps: int = 12, ridge: float = 0.3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels with a ridge penalty, by Newton steps."""
    x = Sparse([[*h, size] for h in hits], size + 1)
    scale = importance / importance.mean()
    w = np.zeros(size + 1)
    penalty = np.full(size + 1, ridge)
    penalty[size] = 1e-3
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x.times(w), -30, 30)))
        curve = scale * p * (1 - p)
        w = w + _solve(lambda v: x.back(curve * x.times(v)) + penalty * v, x.back(curve) + penalty, x.back(scale * (target - p)) - penalty * w)  # noqa: B023
    return w[:size], float(w[size])


def train(docs: DataFrame, labels: DataFrame, usable: Column, max_labelled: int = 8000, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> Model:
    """Fit on the labelled rows where ``usable`` (over the column ``doc_id`` of the labels) holds.

    The lexicon is counted over all of them. The label model and the regression use about ``max_labelled`` rows, half of
    them toxic where there are as many, and where an entry of the lexicon has few rows, these as well; rows are chosen by
    hash of id and text and weighted back. With no toxic row to learn from, every score is the share of toxic rows.

    An id labelled more than once is toxic if any of its labels says so, and then all its texts are. Labels that are null or
    neither 0 nor 1, labels without an id or without a document, and null texts teach nothing.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(toxic_col).cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(usable)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        share = 0.99 if sizes.get(1) else 0.01
        return Model(Lexicon([]), np.zeros(0), float(np.log(share / (1 - share))), np.zeros(0), None)
    kept = {k: sample_fraction(n, max_labelled // 2) for k, n in sizes.items()}
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    rows = settle(texts.join(small(known), "doc_id").select("toxic", "text", place.alias("place")), "labelled")
    counts = rows.select("toxic", "text").mapInPandas(_document_counts, _DF).groupBy("feature").agg(F.sum("toxic_docs").alias("a"), F.sum("clean_docs").alias("b")).where(F.col("a") + F.col("b") >= min_docs)
    a, b = F.col("a"), F.col("b")
    share = sizes[1] / (sizes[0] + sizes[1])
    gain = F.col("a") * F.log((a + 0.1) / ((a + b) * share + 0.1)) + F.col("b") * F.log((b + 0.1) / ((a + b) * (1 - share) + 0.1))
    sure = a / (a + b + 3.84)
    best = counts.select("feature", gain.alias("gain"), sure.alias("sure"), (a + b).alias("rows")).where((F.col("sure") >= 0.5) & (F.col("gain") >= MIN_GAIN)).collect()
    best.sort(key=lambda r: (-r["gain"], r["feature"]))
    lexicon = Lexicon([r["feature"] for r in best])

    chances = np.minimum(1.0, ENTRY_ROWS / np.array([r["rows"] for r in best]))

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for toxic, text, place in zip(batch["toxic"], batch["text"], batch["place"], strict=True):
                own = sorted(lexicon.hits(text))
                chance = max(kept[toxic], chances[own].max(initial=0.0))
                if place < chance:
                    out.append((toxic, own, patterns(text), chance))
            yield pd.DataFrame(out, columns=_HITS.names)

    # About max_labelled rows and ENTRY_ROWS for each entry, whatever the tables hold.
    got = rows.mapInPandas(hits, _HITS).collect()
    found = [r["hits"] for r in got]
    voters = len(best)
    votes = Sparse([[*h, *(voters + i for i, p in enumerate([*r["patterns"], not h]) if p)] for h, r in zip(found, got, strict=True)], voters + PATTERNS)
    sides = np.array([1] * (voters + 2) + [0])
    toxic = np.array([r["toxic"] for r in got])
    # Accuracies and prior of the table, not of the sample with its many toxic rows.
    importance = np.array([1 / r["chance"] for r in got])
    right, wrong = votes.back(importance * toxic), votes.back(importance * (1 - toxic))
    right[-1], wrong[-1] = wrong[-1], right[-1]
    prior = float(np.clip(np.average(toxic, weights=importance), 0.01, 0.99))
    posterior, accuracies, corr = label_model(votes, sides, prior, right, wrong, weights=importance)
    weights, bias = linear(found, len(best), posterior, importance)
    return Model(lexicon, weights, bias, accuracies, corr)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id and the probability of being toxic, from the whole text.

    A null or empty text gets the model's intercept alone. Repeated rows and null ids stay as they are, an empty table gives
    no rows, and other columns are not read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType())])
    whole = isinstance(schema[0].dataType, (T.LongType, T.IntegerType))

    model = replace(model, correlations=None)  # not sent to the executors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64") if whole else batch["doc_id"]
            yield pd.DataFrame({"doc_id": ids, "score": [model.score(t) for t in batch["text"]]})

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, schema)

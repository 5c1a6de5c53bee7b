"""Periodic runs of words, found by recursive frequency splitting and a lag scan.

A run of smallest period q is at least ``max(LEAST, COPIES * q)`` words long, so each of its words occurs ``COPIES`` times or
more inside it. Hence a word that occurs less often within the segment at hand joins no run of that segment and splits it. The
pieces are counted anew, until no piece changes or nothing of ``LEAST`` words is left; all texts of a batch are split
together. Every run lies inside one surviving segment.

In a segment, lags are scanned upwards. With lag q a run shows ``(COPIES - 1) * q`` places in a row where words q apart are
equal, so among the multiples of q there are ``COPIES - 1`` in a row: only those are compared, n / q for lag q, and where
they agree the stretch is followed to both ends. Places inside a run already found, of a smaller period, are passed over:
a run of lag q overlapping it that far would have the smaller period too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 6
COPIES = 4
MASS = 200_000  # words handled together; a longer text is handled alone

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN, False)),
    T.StructField("top", RUN), T.StructField("collapsed", T.StringType()),
])

Prepare = Callable[[int | None, list[bytes]], list[bytes]]


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space; ``bytes.split()`` splits at \\x20 and \\x09-\\x0D only."""
    return text.encode().split() if isinstance(text, str) else []


def segments(ids: np.ndarray, text: np.ndarray) -> list[tuple[int, int]]:
    """Surviving segments (from, to) of word numbers ``ids``; ``text`` tells, by rising numbers, whose words they are."""
    at = np.arange(len(ids))  # places still in question
    part = text.astype(np.int64)
    alphabet = int(ids.max(initial=0)) + 1
    done: list[tuple[int, int]] = []
    while len(at):
        _, inverse, counts = np.unique(part * alphabet + ids[at], return_inverse=True, return_counts=True)
        stays = counts[inverse] >= COPIES
        # A segment goes on where the place before stayed too and belongs to the same segment; none reaches over a gap.
        joined = stays[1:] & stays[:-1] & (part[1:] == part[:-1]) & (at[1:] == at[:-1] + 1)
        opens = np.flatnonzero(stays & np.concatenate([[True], ~joined]))
        closes = np.flatnonzero(stays & np.concatenate([~joined, [True]])) + 1
        long = closes - opens >= LEAST
        opens, closes = opens[long], closes[long]
        first = np.concatenate([[True], part[1:] != part[:-1]])
        last = np.concatenate([first[1:], [True]])
        settled = first[opens] & last[closes - 1]  # the segment is as it was: nothing in it is rare
        done += list(zip(at[opens[settled]].tolist(), (at[closes[settled] - 1] + 1).tolist(), strict=True))
        opens, closes = opens[~settled], closes[~settled]
        sizes = closes - opens
        keep = np.repeat(opens - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(opens) else np.empty(0, np.int64)
        at, part = at[keep], np.repeat(np.arange(len(opens)), sizes)
    return sorted(done)


def _ahead(w: np.ndarray, x: int, lag: int) -> int:
    """The first place from ``x`` on where words ``lag`` apart differ, or the last place compared plus one."""
    end, step = len(w) - lag, 32
    while x < end:
        to = min(end, x + step)
        differ = w[x:to] != w[x + lag:to + lag]
        if differ.any():
            return x + int(differ.argmax())
        x, step = to, step * 2
    return end


def _behind(w: np.ndarray, x: int, lag: int) -> int:
    """The first place of the stretch of equal words ``lag`` apart that ends at ``x``."""
    step = 32
    while x > 0:
        to = max(0, x - step)
        differ = w[to:x] != w[to + lag:x + lag]
        if differ.any():
            return x - int(differ[::-1].argmax())
        x, step = to, step * 2
    return 0


def scan(w: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of one segment."""
    n, found = len(w), []
    covered = np.zeros(n, np.int64)  # where the runs over a place end, at most
    for lag in range(1, n // COPIES + 1):
        marks = w[::lag]
        equal = marks[1:] == marks[:-1]
        hits = equal[: len(equal) - COPIES + 2].copy()
        for k in range(1, COPIES - 1):
            hits &= equal[k: len(equal) - COPIES + 2 + k]
        at = np.flatnonzero(hits) * lag
        at = at[covered[at] <= at + (COPIES - 1) * lag]
        passed = -1
        for x in at.tolist():
            if x < passed or covered[x] > x + (COPIES - 1) * lag:
                continue
            passed = _ahead(w, x, lag)
            if passed <= x + (COPIES - 2) * lag:  # equal at the multiples only
                continue
            start = _behind(w, x, lag)
            length = passed + lag - start
            if length >= max(LEAST, COPIES * lag):
                found.append((start, length, lag))
                np.maximum(covered[start:start + length], start + length, out=covered[start:start + length])
    return found


def find(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of every text by start, then period."""
    known: dict[bytes, int] = {}
    sizes = [len(t) for t in texts]
    ids = np.fromiter((known.setdefault(w, len(known)) for t in texts for w in t), np.int64, sum(sizes))
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in segments(ids, np.repeat(np.arange(len(texts)), sizes)):
        text = int(np.searchsorted(starts, a, side="right")) - 1
        runs[text] += [(a - int(starts[text]) + s, length, q) for s, length, q in scan(ids[a:b])]
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def top(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length over period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapse(text: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words that no run holds after its first period, joined by one space."""
    if not runs:
        return b" ".join(text).decode()
    edge = np.zeros(len(text) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([text[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]).decode()


def detect(docs: DataFrame, prepare: Prepare | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs (start, length, period; by start, then period), top, collapsed.

    A run is a stretch of words with smallest period q and at least ``max(6, 4 * q)`` words that neither neighbour extends;
    ``top`` is the one with the greatest length over period, null without runs. ``collapsed`` leaves out every word that a
    run holds after its first q words. A null, empty or blank text has no words and no runs, ids may be null or repeat,
    repeated rows give repeated rows, an empty table gives none, and other columns are not read. Whole texts are read, in a
    map without a shuffle; a task holds the words of about ``MASS`` or of one text. ``prepare(doc_id, words)`` may
    replace the words of a text first.
    """

    def rows(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        found = find(texts)
        name = lambda r: None if r is None else dict(zip(RUN.names, r, strict=True))
        return pd.DataFrame({
            "doc_id": pd.array(ids, "Int64"), "n_words": [len(t) for t in texts], "runs": pd.Series([[name(r) for r in f] for f in found], dtype=object),
            "top": pd.Series([name(top(f)) for f in found], dtype=object), "collapsed": [collapse(t, f) for t, f in zip(texts, found, strict=True)],
        })

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts, mass = [], [], 0
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                own = words(text)
                ids.append(doc_id)
                texts.append(prepare(None if doc_id is pd.NA else doc_id, own) if prepare else own)
                mass += len(own)
                if mass > MASS:
                    yield rows(ids, texts)
                    ids, texts, mass = [], [], 0
            if ids:
                yield rows(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)

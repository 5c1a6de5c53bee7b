"""Periodic runs against a plain version over all starts and periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from returnlens.llm import runs
from returnlens.llm.queries import QUERIES
from tests.llm.test_operators import LONG, ROWS, SF, awkward, documents  # noqa: F401


def plain_runs(w):
    """Every stretch in which words q apart agree, as far as it goes, if no smaller period holds in it."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in dropped)
    return (len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_against_the_plain_version(spark):
    docs = documents(spark)
    rows = QUERIES["op13_runs"](spark, SF).collect()
    short = {i: t for i, t in docs.items() if len((t or "").split()) < 1500}
    assert len(rows) == len(docs) and len(short) > 150
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in rows if r["doc_id"] in short}
    assert got == {i: plain_row(i, t) for i, t in short.items()}
    assert any(r["n_runs"] for r in rows) and any(r["n_runs"] == 0 for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_find_on_made_texts(seed):
    rng = random.Random(seed)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 4)):
            letters, w = rng.randint(1, 6), []
            while rng.random() < 0.9 and len(w) < 160:
                if rng.random() < 0.5:
                    unit = [b"%d" % rng.randint(0, letters) for _ in range(rng.randint(1, 7))]
                    w += [unit[i % len(unit)] for i in range(rng.randint(1, 60))]
                else:
                    w += [b"%d" % rng.randint(0, letters) for _ in range(rng.randint(0, 20))]
            texts.append(w)
        assert runs.find(texts) == [plain_runs(w) for w in texts]


def test_thresholds_and_nested_runs():
    assert runs.find([b"x a a a a a y".split()]) == [[]]
    assert runs.find([b"x a a a a a a y".split()]) == [[(1, 6, 1)]]
    assert runs.find([b"a b a b a b a".split()]) == [[]]
    assert runs.find([b"a b a b a b a b".split()]) == [[(0, 8, 2)]]
    inner = b"a a a a a a b ".split()
    assert runs.find([inner * 4]) == [sorted([(7 * k, 6, 1) for k in range(4)] + [(0, 28, 7)], key=lambda r: (r[0], r[2]))]
    assert runs.top([(0, 28, 7), (0, 6, 1), (7, 6, 1)]) == (0, 6, 1) and runs.top([]) is None
    assert runs.top([(9, 13, 3), (2, 26, 6)]) == (2, 26, 6)  # equal ratios: the smaller start


def test_splitting_leaves_what_can_hold_a_run():
    import numpy as np

    known = {}
    text = "p q r s t a b a b a b a b u v w a b".split()
    ids = np.array([known.setdefault(w, len(known)) for w in text])
    assert runs.segments(ids, np.zeros(len(ids), np.int64)) == [(5, 13)]
    assert runs.segments(np.empty(0, np.int64), np.empty(0, np.int64)) == []


def test_long_texts_take_time_near_linear():
    import time

    began = time.time()
    assert runs.find([[b"a"] * 300_000]) == [[(0, 300_000, 1)]]
    assert runs.find([b"the quick brown fox jumps over a lazy dog".split() * 30_000]) == [[(0, 270_000, 9)]]
    assert time.time() - began < 60


def test_awkward_rows(spark, awkward):  # noqa: F811
    rows = runs.detect(awkward).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    assert all(got[i]["n_words"] == 0 and got[i]["runs"] == [] and got[i]["top"] is None and got[i]["collapsed"] == "" for i in (2, 3, 4))
    n = len(LONG.split())
    assert [tuple(r) for r in got[6]["runs"]] == [(0, n, 9)] and got[6]["collapsed"] == "the quick brown fox jumps over a lazy dog"
    assert got[None]["collapsed"] == "a row without an id" and got[10]["collapsed"].startswith("Ünïcödé")
    assert runs.detect(awkward.limit(0)).count() == 0


def test_unicode_spaces_do_not_cut_words(spark):
    docs = spark.createDataFrame([(1, "a\xa0b " * 6), (2, "a\x1cb\x85 " * 6)], "doc_id long, text string")
    assert [[tuple(x) for x in r["runs"]] for r in runs.detect(docs).orderBy(F.col("doc_id")).collect()] == [[(0, 6, 1)], [(0, 6, 1)]]

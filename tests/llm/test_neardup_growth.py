"""How many pairs near-duplicate detection compares, and links that hang on one id with several texts."""

import itertools

import numpy as np
import pytest

from returnlens.llm import neardup
from tests.llm.test_operators import plain_classes


def counted(spark, monkeypatch, texts, size=3, percent=85):
    """(components by id, pairs of every round, pairs of the last step)."""
    seen = {}
    rounds, crossing = neardup.rounds, neardup.crossing

    def kept(name, call):
        def run(*args):
            seen[name] = call(*args)
            return seen[name]

        return run

    monkeypatch.setattr(neardup, "rounds", kept("rounds", rounds))
    monkeypatch.setattr(neardup, "crossing", kept("crossing", crossing))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(docs, shingle=size, percent=percent).collect()}
    monkeypatch.undo()
    return got, [r[0] for r in seen["rounds"]], seen["crossing"].count()


def near_copies(count, seed=5, words=120, most=3, fresh=False):
    """Texts of one base with up to ``most`` words replaced, ``fresh`` by words no other text has."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(words)]
    out = {}
    for i in range(count):
        own = list(base)
        for k in rng.choice(words, most if fresh else rng.integers(1, most + 1), replace=False):
            own[k] = f"e{i}_{k}" if fresh else f"e{rng.integers(0, 40)}"
        out[i] = " ".join(own)
    return out


def test_a_large_group_of_near_copies_is_compared_once_a_class_and_round(spark, monkeypatch):
    for count in (1000, 2000):
        texts = near_copies(count, most=2)
        got, rounds, last = counted(spark, monkeypatch, texts)
        if count == 1000:
            assert got == plain_classes(texts, 3, 85)
        assert all(r <= count for r in rounds) and sum(rounds) + last <= 3 * count


def test_texts_of_one_template_are_not_paired_with_each_other(spark, monkeypatch):
    found = {}
    for count in (400, 800):
        texts = near_copies(count, words=80, most=5, fresh=True)
        got, rounds, last = counted(spark, monkeypatch, texts)
        assert {i: c for i, (_, c) in got.items()} == {i: i for i in texts}
        found[count] = sum(rounds) + last
    assert found[800] <= 2.5 * max(found[400], 100)


def test_a_split_bucket_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", 1)  # every bucket is split by rare shingles
    monkeypatch.setattr(neardup, "FRUITFUL", 2.0)  # after one round
    texts = near_copies(150, most=9) | {1000 + i: t for i, t in near_copies(100, seed=9, words=60, most=2).items()}
    for size, percent in ((3, 85), (5, 80)):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(docs, shingle=size, percent=percent).collect()}
        assert got == plain_classes(texts, size, percent)


A, B = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))


@pytest.mark.parametrize("order", list(itertools.permutations(range(4)))[::23])
def test_an_id_with_two_texts_links_what_is_near_either(spark, order):
    rows = [(1, A), (1, B), (2, A + " z"), (3, B + " z")]
    docs = spark.createDataFrame([rows[i] for i in order] + [(9, "alone on the page")], "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.classes(docs, shingle=3, percent=85).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (9, 9, True)}


def test_an_id_with_three_unrelated_texts_and_none(spark):
    rows = [(5, A), (5, B), (5, "some third text that is here"), (5, None), (6, B), (4, "x y z"), (None, A)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in neardup.classes(docs, shingle=3, percent=85).collect())
    assert got == [(0, 58, 0), (4, 1, 4), (5, 0, 5), (5, 4, 5), (5, 58, 5), (5, 58, 5), (6, 58, 5)]

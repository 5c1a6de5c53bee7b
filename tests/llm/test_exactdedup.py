"""Exact duplicates against a plain version, with groups within and across history and new rows."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnlens.llm import exactdedup
from returnlens.llm.exactdedup import PerfectHash
from returnlens.llm.queries import QUERIES
from tests.llm.test_operators import ROWS, SF, awkward, documents  # noqa: F401


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_groups(rows):
    """Sorted (doc_id, keep_id, size, sha) of (id, text) rows."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    kept = [r["text_sha256"] for r in rows if r["kept"]]
    assert sorted(kept) == sorted({r["text_sha256"] for r in rows})  # one row of every group
    assert all(r["doc_id"] == r["keep_id"] for r in rows if r["kept"])
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str)


def test_query_against_the_plain_version(spark):
    docs = list(documents(spark).items())
    assert found(QUERIES["op12_exactdedup"](spark, SF)) == plain_groups(docs)


@pytest.mark.parametrize("seen", ["doc_id % 2 = 0", "true", "false", "null", "doc_id < 40", "doc_id > 3000"])
def test_any_history_gives_the_same_groups(spark, seen):
    rows = [(i, f"text {i % 300}") for i in range(2, 900)] + [(3000 + i, "a  hot\ttext") for i in range(500)] + [(1, "text 7"), (9999, "only once")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for options in ({}, {"shard_rows": 40, "broadcast_rows": 0}):
        assert found(exactdedup.dedup(docs, F.expr(seen).cast("boolean"), **options)) == plain_groups(rows)


def test_white_space_and_other_spaces(spark):
    rows = [(1, "a b"), (2, "a \t\n\x0b\x0c\r b"), (3, " a b"), (4, "a b"), (5, "a\x1cb"), (6, "A b"), (7, "a b ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(exactdedup.dedup(docs, F.lit(True))) == plain_groups(rows)


def test_awkward_rows(spark, awkward):  # noqa: F811
    rows = [(i, t) for i, t, _ in ROWS]
    assert found(exactdedup.dedup(awkward, F.col("doc_id") < 5)) == plain_groups(rows)
    nameless = [(None, "x"), (None, "x"), (None, "y"), (4, "y"), (4, "y"), (3, None), (2, "")]
    docs = spark.createDataFrame(nameless, "doc_id long, text string")
    assert found(exactdedup.dedup(docs, F.col("doc_id") == 4)) == plain_groups(nameless)
    assert exactdedup.dedup(docs.limit(0), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash_is_minimal_and_survives_packing(n):
    words = np.frombuffer(np.random.default_rng(n).bytes(32 * n), np.uint64).reshape(-1, 4) if n else np.empty((0, 4), np.uint64)
    built = PerfectHash.build(words)
    again = PerfectHash.unpacked(built.widths, built.packed())
    assert sorted(again.slots(words).tolist()) == list(range(n))
    others = np.frombuffer(np.random.default_rng(n + 1).bytes(32 * 1000), np.uint64).reshape(-1, 4)
    assert ((again.slots(others) >= -1) & (again.slots(others) < max(n, 1))).all()


def test_digests_that_share_words_still_find_their_slots():
    words = np.zeros((400, 4), np.uint64)
    words[:, 3] = np.arange(400)
    assert sorted(PerfectHash.build(words).slots(words).tolist()) == list(range(400))


def test_a_foreign_digest_on_a_slot_is_no_member():
    import pandas as pd

    old = [hashlib.sha256(b"old %d" % i).digest() for i in range(50)]
    new = [hashlib.sha256(b"new %d" % i).digest() for i in range(500)] + old[:5]

    def frame(digests, first):
        return pd.DataFrame({"shard": 0, "digest": digests, "unnamed": False, "id": pd.array(range(first, first + len(digests)), "Int64"), "row": range(len(digests)), "size": 1})

    out = exactdedup._look_up(frame(new, 1000), exactdedup._index(frame(old, 0)))
    sizes = dict(zip(out["digest"], out["size"], strict=True))
    assert len(out) == 550 and all(sizes[d] == (2 if d in old[:5] else 1) for d in [*old, *new])

"""Pages of an ordering against a sorted list."""

import random

from pyspark.sql import functions as F

from returnlens.operators.paging import Pages


def test_pages_against_a_sorted_list(spark):
    rng = random.Random(2)
    rows = [(rng.randint(0, 40) if rng.random() < 0.7 else 7, i, None if i % 11 == 0 else i % 5) for i in range(3000)]
    rng.shuffle(rows)
    pages = Pages(spark.createDataFrame(rows, "a int, b int, c int").repartition(6), [F.col("a").desc(), F.col("b").asc()], ranges=16)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert pages.total == 3000
    for offset, limit in ((0, 10), (1490, 25), (2990, 50), (3000, 5), (700, 900), (5, 0)):
        got = sorted(tuple(r) for r in pages.page(offset, limit).collect())
        assert got == [(offset + i, *r) for i, r in enumerate(want[offset:offset + limit])]


def test_pages_of_an_empty_table(spark):
    pages = Pages(spark.createDataFrame([], "a int"), [F.col("a").asc()])
    assert pages.total == 0 and pages.page(0, 10).count() == 0

"""What is handed to Python at once stays small however many texts a task has."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from returnlens.llm import langid, packing

ROWS, CHARS = 6000, 4800


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    """29 MB of text in one task."""
    path = str(tmp_path_factory.mktemp("long") / "documents")
    text = F.repeat(F.concat(F.lit("some words of text "), F.pmod("id", F.lit(10)), F.lit(" and ")), CHARS // 25)
    spark.range(ROWS).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("en").alias("lang")).coalesce(1).write.parquet(path)
    return spark.read.parquet(path).coalesce(1)


def held(spark, work):
    """The most bytes that Arrow holds outside the heap while ``work`` runs, beyond what it held before; and its result."""
    arrow = spark._jvm.org.apache.spark.sql.util.ArrowUtils.rootAllocator()
    before, seen, over = arrow.getAllocatedMemory(), [], threading.Event()

    def watch():
        while not over.is_set():
            seen.append(arrow.getAllocatedMemory() - before)
            time.sleep(0.002)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        return work(), max(seen)
    finally:
        over.set()
        watcher.join()


def test_language_keeps_rows_without_moving_them(spark, docs, tmp_path):
    profiles = langid.train(docs.limit(100), F.lit(True))
    found, most = held(spark, lambda: langid.keep_identified(docs, profiles).write.parquet(str(tmp_path / "out")))
    assert sorted(spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(docs.collect())
    assert most < 10_000_000


def test_packing_takes_few_texts_at_a_time(spark, docs, tmp_path):
    _, most = held(spark, lambda: packing.pack(docs).write.parquet(str(tmp_path / "out")))
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id").distinct().count() == ROWS
    assert 0 < most < 10_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000"

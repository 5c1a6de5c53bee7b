"""The corpus pipeline: five stages over ``documents``, each of which calls one operator of the optional subpackage.

Language identification drops documents without letters, near-duplicate detection keeps one document of each group,
decontamination drops documents that hold a benchmark item, personal data is replaced by its kind, and what is left is
packed into training sequences. All but the last stage return the columns of ``documents``.

Stages that drop documents drop rows, by a key they number them with themselves: ids may be missing, repeat or stand for
several texts. Every stage keeps rows with a null id that give it no reason to drop them, takes a null or empty text as an
empty one, and returns an empty table for an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.llm import decontaminate, langid, neardup, packing, pii
from returnlens.llm.common import fold, small, table
from returnlens.session import scratch, settle

#: Trained profiles, sketches and packing cannot be said in SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a number for each row, which is written so that it stays the same, and the name of its column."""
    key = "row_key"
    while key in docs.columns:
        key += "_"
    return settle(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def without(docs: DataFrame, key: str, dropped: DataFrame) -> DataFrame:
    return docs.join(small(settle(dropped, "dropped")), key, "left_anti").drop(key)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language: null texts and texts without a letter. ``lang`` keeps what the table says."""
    profiles = langid.train(docs, fold(F.col("doc_id"), 5) != 0)
    return langid.keep_identified(docs, profiles)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates (five words, 0.8): the one with the smallest id, a null id last.

    Of several rows with that id one stays. Texts without words are in no group.
    """
    rows, key = keyed(docs)
    found = neardup.classes(rows, shingle=5, percent=80, id_col=key)
    copies = settle(found.where(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("component_id").alias("component")), "copies")
    members = copies.union(copies.select("component", "component").distinct())
    ids = rows.select(key, F.col("doc_id").alias("id"))
    named = members.join(ids, key)
    stays = named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", key))[key].alias(key)).select(key)
    return without(rows, key, members.select(key).join(stays, key, "left_anti"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every row that holds four fifths or more of a benchmark item's five-word shingles, whatever its id."""
    rows, key = keyed(docs)
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), size=5, share=0.8, id_col=key)
    return without(rows, key, found.select(F.col("doc_id").alias(key)).distinct())


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind; ``n_chars`` is the new length."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identified), ("near_duplicates", deduplicated), ("decontamination", decontaminated), ("personal_data", redacted), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences of all stages; none of the tables in between is left behind."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            docs = settle(stage(spark, docs, sf_dir), name, keep=name == STAGES[-1][0])
    return docs

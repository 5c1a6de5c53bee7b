"""Every stage of the pipeline on what the stage before it kept, and against plain versions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import holds, plain_classes, plain_spans, shingles

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stages"))
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs[-1], SF).write.parquet(f"{folder}/{name}")
        docs.append(spark.read.parquet(f"{folder}/{name}"))
    return docs


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_language_drops_documents_without_letters_only(stages):
    before = texts(stages[0])
    assert texts(stages[1]) == {i: t for i, t in before.items() if t and any(map(str.isalpha, t))}


def test_one_document_of_each_group_stays(stages):
    before = texts(stages[1])
    want = {i: t for i, t in before.items() if plain_of(before)[i][1] == i}
    assert texts(stages[2]) == want and len(want) < len(before)


def plain_of(before, memo={}):  # noqa: B006
    key = tuple(sorted(before))
    if key not in memo:
        memo[key] = plain_classes(before, 5, 80)
    return memo[key]


def test_contaminated_documents_go(spark, stages):
    items = [shingles(r["text"], 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = texts(stages[2])
    bad = {i for i, t in before.items() if any(len(s & shingles(t, 5)) >= 0.8 * len(s) - 1e-9 for s in items)}
    assert bad and texts(stages[3]) == {i: t for i, t in before.items() if i not in bad}


def test_personal_data_is_gone_and_lengths_follow(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    for i, t in before.items():
        found = plain_spans(t)
        assert (after[i] == t) if not found else not set(plain_spans(after[i])) and after[i] != t
    assert stages[4].where(F.col("n_chars") != F.length("text")).count() == 0


def test_packing_holds_what_is_left(stages):
    holds(stages[5].collect(), texts(stages[4]))


def test_run_is_the_stages(spark, stages):
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(key).collect())) == sorted(map(tuple, stages[5].select(key).collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_without_an_id_and_repeated_ids(spark, tmp_path):
    """Copies go and benchmark items go whatever the ids; of several rows with the smallest id one stays."""
    item = " ".join(f"bench{i}" for i in range(30))
    spark.createDataFrame([("q1", item)], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    long = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    rows = [
        (7, long), (None, long), (3, long + " end"), (3, long), (None, other), (None, other), (8, "held by one id"), (8, "and another text of it"),
        (8, "so it said " + item), (None, "this row too " + item + " has it"), (None, None), (2, ""),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int, row_key int")
    stages = dict(corpus_pipeline.STAGES)
    kept = [(r["doc_id"], r["text"]) for r in stages["near_duplicates"](spark, docs, str(tmp_path)).collect()]
    group = {(3, long + " end"), (3, long)}
    assert len(kept) == 12 - 4 and len(group & set(kept)) == 1 and (7, long) not in kept and kept.count((None, other)) == 1
    left = stages["decontamination"](spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=key) == sorted([r for r in rows if not r[1] or item not in r[1]], key=key)


def test_run_leaves_only_what_its_result_reads(spark):
    import os

    from returnlens.session import checkpoint_dir

    def folders():
        top = f"{checkpoint_dir(spark)}/returnlens/{spark.sparkContext.applicationId}".removeprefix("file:")
        return set(os.listdir(top)) if os.path.isdir(top) else set()

    before = folders()
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert len(folders() - before) == 1

"""Fill-in-middle transformation against a plain version, its round trip, and awkward rows."""

import hashlib

import pytest

from returnlens.llm import fim
from returnlens.llm.queries import QUERIES
from tests.llm.test_operators import LONG, ROWS, SF, awkward, documents  # noqa: F401


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text):
    """(n, form, prefix, middle, output) by slicing a list of code points."""
    units = list(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    x, m, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", a, b - a, f"<S>{z}<P>{x}<M>{m}"
    return len(units), "psm", a, b - a, f"<P>{x}<S>{z}<M>{m}"


def test_query_against_the_plain_version(spark):
    docs, forms = documents(spark), set()
    rows = QUERIES["op11_fim"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]] or ""
        n, form, x, m, output = plain_fim(r["doc_id"], text)
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output_sha256"], r["restored_sha256"]) == (n, form, x, m, sha(output), sha(text))
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_outputs_and_round_trip(spark):
    texts = ["", "x", "a <P> mark", "<S>", "almost <P < S> <<P", "<" * 9, "éà́ 日本 \U0001F600\r\n end", "tail <", LONG]
    rows = [(i * 100 + k, t) for i, t in enumerate(texts) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = fim.transform(docs).withColumn("restored", fim.restore(fim.F.col("output"), fim.F.col("form"))).collect()
    texts_of = dict(rows)
    assert len(made) == len(rows)
    for r in made:
        text = texts_of[r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == plain_fim(r["doc_id"], text)
        assert r["restored"] == text


def test_awkward_rows(spark, awkward):  # noqa: F811
    rows = fim.transform(awkward).collect()
    assert len(rows) == len(ROWS)
    want = sorted((plain_fim(i, t or "") + (i or -1,) for i, t, _ in ROWS), key=str)
    assert sorted(((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["doc_id"] or -1) for r in rows), key=str) == want
    assert fim.transform(awkward.limit(0)).count() == 0


def test_long_texts_are_matched_in_stretches(monkeypatch):
    monkeypatch.setattr(fim, "STRETCH", 10)
    fim._patterns.cache_clear()
    text = "".join(chr(0x3B1 + i % 20) for i in range(95))
    cuts = fim.Cuts(text)
    assert len(cuts.parts) == 10 and len(cuts) == 95 and [cuts.after(k) for k in range(96)] == list(range(96))
    fim._patterns.cache_clear()


def test_very_long_text(spark):
    text = "é日x " * 2_000_000
    assert len(fim.Cuts(text)) == len(text)


def test_other_units():
    cuts = fim.Cuts("one two  three", r"\S+\s*")
    assert len(cuts) == 3 and [cuts.after(k) for k in range(4)] == [0, 4, 9, 14]
    assert len(fim.Cuts("éx\r\n", r"\X")) == 3
    with pytest.raises(ValueError, match="not a sequence"):
        fim.Cuts(" one", r"\S+\s*")

"""Filing files read from a folder, checked, and duplicate accessions resolved."""

import json

from returnlens.sources import filings


def record(ticker, accession, text, **extra):
    return json.dumps({"ticker": ticker, "doc_id": accession, "title": "8-k", "text": text, "date": "2026-01-02",
                       "available_at": "2026-01-02T10:00:00Z", **extra})


def test_corpus(spark, tmp_path):
    acc = "0000000001-26-000001"
    (tmp_path / "sub").mkdir()
    files = {
        f"BRK-B-{acc}.jsonl": record("BRK-B", acc, " line\r\nnext\r \x00") + "\n" + record("BRK-B", acc, "second line ignored"),
        f"sub/ABR-PF-{acc}.jsonl": record("ABR-PF", acc, "a much longer text than the other one"),
        "X-0000000002-26-000002.jsonl": record("X", "0000000002-26-000003", "text"),
        "X-0000000004-26-000004.jsonl": record("Y", "0000000004-26-000004", "text"),
        "X-0000000005-26-000005.jsonl": record("X", "0000000005-26-000005", "  \n "),
        "notes.jsonl": record("X", "n", "text"),
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    seen = filings.check_filings(filings.read_filings(spark, str(tmp_path)))
    reasons = sorted(r.rejection_reason for r in seen.collect() if r.rejection_reason)
    assert reasons == ["accession does not match doc_id", "file name does not match", "missing filing text", "ticker does not match payload"]
    good = filings.valid(seen)
    chosen = filings.choose_filings(good).collect()
    assert len(chosen) == 1 and chosen[0].canonical_ticker == "BRK.B" and chosen[0].text_length == len("line\nnext")
    assert {r.source_ticker for r in filings.accession_aliases(good).collect()} == {"BRK-B", "ABR-PF"}
    assert filings.mixed_hash_issues(good).count() == 1
    assert {r.metric: r.value for r in filings.scan_report(seen).collect()}["duplicate_accessions"] == 1

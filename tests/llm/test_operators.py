"""The operators against plain versions, on the smallest tables and on rows made to be awkward."""

import hashlib
import html as entities
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from returnlens.llm import components, decontaminate, html, langid, neardup, packing, pii, sharding, topk, toxicity, urls
from returnlens.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over a lazy dog " * 4000
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en"), (2, None, None), (3, "", "en"), (4, "   \n\t ", "de"),
    (5, "The quick brown fox jumps over the lazy dog near the river bank today", "en"), (5, "The quick brown fox jumps over the lazy dog near the river bank today", "en"),
    (6, LONG, "en"), (7, "two words", "en"), (8, "TWO\nwords", None), (None, "a row without an id", "en"), (9, "123 456 !!", "en"), (10, "Ünïcödé ß ñandú 日本語 \U0001F600 end", "de"),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and very long texts, repeated rows, and columns named like what the operators use inside."""
    rows = [(*r, 7, "x", "y", 1) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, source string, component_id string, shard int")


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, size):
    w = words(text)
    return frozenset(tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_queries_are_registered():
    assert sorted({int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES}) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


# sharding


def test_sharding_keeps_groups_and_slots(spark):
    docs = documents(spark)
    rows = QUERIES["op1_sharding"](spark, SF).collect()
    assert len(rows) == len(docs)
    by_text, slots, load = {}, {}, Counter()
    for r in rows:
        text = docs[r["doc_id"]] or ""
        assert r["size"] == len(text.encode()) + 1 and r["text_crc32"] == zlib.crc32(text.encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        by_text.setdefault(text, set()).add(r["shard"])
        slots.setdefault(r["shard"], []).append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for text in docs.values():
        groups[text or ""] += len((text or "").encode()) + 1
    assert max(load.values()) - min(load.values()) <= max(groups.values())


def test_sharding_places_largest_first():
    assert least_load([9, 7, 6, 5, 4], 2) == [17, 14]


def least_load(sizes, shards):
    got = sharding.least_loaded([(s, f"{i}") for i, s in enumerate(sizes)], shards)
    return sorted((sum(s for i, s in enumerate(sizes) if got[f"{i}"] == k) for k in range(shards)), reverse=True)


def test_sharding_awkward(spark, awkward):
    rows = sharding.shard(awkward, shards=3).collect()
    assert len(rows) == len(ROWS) and len({r["shard"] for r in rows if r["doc_id"] in (1, 5)}) == 1
    assert sharding.shard(awkward.limit(0)).count() == 0


# toxicity


def test_toxicity_learns_from_labels(spark):
    rows = [(i, ("you are such a grubnik person here " if i % 4 == 0 else "you are such a kind person here ") + f"word{i % 7} filler", int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "grubnik grubnik")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(900, 1), (None, 0), (902, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 3 != 1)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == (y == 1) for i, _, y in rows)
    assert got[None] >= 0.7 and got[900] == got[901] < 0.7
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_toxicity_without_labels(spark, awkward):
    model = toxicity.train(awkward, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    assert {r["score"] < 0.7 for r in toxicity.score(awkward, model).collect()} == {True}


def made_up(n):
    """Words of ten letters, no two with the same beginning of four."""
    return ["".join(chr(97 + i // 20 ** k % 20) for k in range(4)) + "uvwxyz" for i in range(n)]


def trained(spark, rows, **named):
    """Scores of (text, toxic) rows by a model learned from all of them."""
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True), **named)
    return model, [r["score"] for r in toxicity.score(docs, model).orderBy("doc_id").collect()]


def test_toxicity_of_a_copied_text_does_not_crowd_out_the_terms(spark):
    rows = [(" ".join(made_up(260)), 1)] * 150
    rows += [(f"you are such a {('grubnik', 'vermlin', 'slodge')[i % 3]} person number n{i} here", 1) for i in range(300)]
    rows += [(f"you are such a kind person number n{i} here", 0) for i in range(1500)]
    model, _ = trained(spark, rows)
    assert {"grubnik$", "vermlin$", "slodge$"} <= set(model.lexicon.at) and len(model.lexicon.at) > 1300


def test_toxicity_absence_is_of_all_entries(spark):
    many, few = made_up(120), ["grubnik", "vermlin", "slodge"]
    rows = [(" ".join(many[i % 3::3]), 1) for i in range(300)]
    rows += [(f"you are such a {few[i % 3]} person number n{i} here", 1) for i in range(90)]
    rows += [(f"you are such a kind person number n{i} here", 0) for i in range(1500)]
    model, scores = trained(spark, rows)
    assert len(model.lexicon.at) > 500 and min(model.lexicon.at[f"{w}$"] for w in few) >= 300
    assert all((x >= 0.7) == (y == 1) for x, (_, y) in zip(scores, rows, strict=True))


def test_toxicity_counts_terms_over_all_labelled_rows(spark):
    rows = [(f"you are such a {'zorgblat' if i % 80 == 0 else 'grubnik'} person number n{i} here", 1) for i in range(1600)]
    rows += [(f"you are such a kind person number n{i} here", 0) for i in range(1600)]
    model, scores = trained(spark, rows, max_labelled=200)
    assert "zorgblat$" in model.lexicon.at
    assert all((x >= 0.7) == (y == 1) for x, (_, y) in zip(scores, rows, strict=True))


def test_crowding_is_the_sum_of_close_correlations():
    rng = np.random.default_rng(2)
    q, own = rng.random(400), rng.random((400, 5)) < 0.3
    votes = own[:, [0, 1, 2, 0, 3, 4, 1, 0]].astype(float)
    votes[:6, 3] = 0
    sides = np.array([1, 1, 1, 1, 1, 0, 1, 0])
    left = votes - np.outer(q, q @ votes / q.sum()) - np.outer(1 - q, (1 - q) @ votes / (1 - q).sum())
    corr = (left.T @ left) / np.sqrt(np.outer((left * left).sum(axis=0), (left * left).sum(axis=0)))
    close = np.where((corr > 0.8) & (sides[:, None] == sides[None, :]) & ~np.eye(8, dtype=bool), corr, 0)
    found = toxicity.Correlations(toxicity.Sparse([list(np.flatnonzero(v)) for v in votes], 8), q)
    for block in (3, 1024):
        assert np.allclose(found.crowding(sides, block=block), close.sum(axis=1), atol=1e-4)
    assert abs(found[0, 3] - corr[0, 3]) < 1e-4 and close[0, 3] > 0.8


def test_linear_is_the_best_fit():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 12)) < 0.2).astype(float)
    target, importance = rng.random(300), rng.random(300) + 0.5
    w, bias = toxicity.linear([list(np.flatnonzero(r)) for r in x], 12, target, importance)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    scale = importance / importance.mean()
    assert np.abs(x.T @ (scale * (target - p)) - 0.3 * w).max() < 1e-6 and abs((scale * (target - p)).sum() - 1e-3 * bias) < 1e-6


def test_label_model_shares_the_weight_of_copies():
    rng = np.random.default_rng(0)
    y = rng.random(600) < 0.3
    good = (y & (rng.random(600) < 0.8)) | (~y & (rng.random(600) < 0.03))
    votes = np.stack([good, good, good, ~good], axis=1).astype(float)
    sides = np.array([1, 1, 1, 0])
    right, wrong = y @ votes, (~y) @ votes
    right[-1], wrong[-1] = wrong[-1], right[-1]
    q, accuracy, corr = toxicity.label_model(votes, sides, 0.3, right, wrong)
    assert corr[0, 1] > 0.99 and q[good].mean() < 0.999
    assert ((q > 0.5) == good).all()


# urls


def plain_rule(host, path):
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text)) if fits else None


def test_urls(spark):
    given = [
        "http://a.com", "https://A.COM/", "http://example.com/en/x", "https://www.Example.com/en/x?q=/es/", "http://x.net/es/1", "http://x.net/es", "http://x.net#a/es/", None, "no scheme",
        "://h/p", "http://free-casino-bets.org/play", "http://daily-news-library.org/history", "ftp://net/fr/://x", "http://xcom/", "",
    ]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(given)] + [(None, "http://a.com/", "c")], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    for i, url in enumerate(given):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        rule = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule.text if rule else None)
        if rule:
            assert got[i]["verdict"] == rule.verdict
    assert got[10]["verdict"] == "block" and got[11]["verdict"] == "allow" and got[7]["verdict"] == "allow"
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_urls_of_a_million_characters(spark):
    import time

    pages = spark.createDataFrame([(1, "http://a.com/" + "xé/" * 350_000), (2, "http://free-casino-bets.org/" + "ab" * 500_000)], "page_id long, url string")
    weights = urls._table(spark)
    began = time.time()
    got = {r["page_id"]: r for r in urls.filter_urls(pages, labelled=weights).collect()}
    assert len(got[1]["path"]) == 1_050_001 and got[1]["verdict"] in ("allow", "block") and time.time() - began < 60


# packing


def test_differencing_is_near_equal_and_windows_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 257, 500).tolist()
    parts = packing.differencing(sizes, 32)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(500)) and max(sums) - min(sums) <= 4
    assert all(sum(sizes[i] for i in p) <= 300 for p in packing.windows_of(sizes, 300))
    assert len(packing.windows_of([2, 2, 2], 3)) == 3  # two would hold the sum, but not the pieces
    assert packing.windows_of([], 10) == []


def tokens(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokens.loaded = getattr(tokens, "loaded", None) or Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [*tokens.loaded.encode(text or "", add_special_tokens=False).ids, 1]


def holds(rows, texts):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc_id, pieces in by_doc.items():
        ids = tokens(texts[doc_id])
        at = 0
        for p in sorted(pieces, key=lambda p: p["start"]):
            part = np.array(ids[p["start"]:p["start"] + p["length"]], "<u4").tobytes()
            assert p["start"] == at and p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(part)
            at += p["length"]
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= packing.CAPACITY
    assert set(by_doc) == set(texts)
    return sum(r["length"] for r in rows), len(by_sequence)


def test_packing_round_trip(spark):
    total, sequences = holds(QUERIES["op4_packing"](spark, SF).collect(), documents(spark))
    assert sequences * packing.CAPACITY <= total * 1.03 + packing.CAPACITY


def test_packing_awkward(spark):
    texts = {i: t for i, t in enumerate([None, "", "  ", LONG, "<|endoftext|> inside", "a\x1cb", "ΣΑΣ it's 3.14 İ", "éà naïve, x.y", "don't!? ... \U0001F600", "x" * 5000])}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, sequence_id int")
    holds(packing.pack(docs, windows=2).collect(), texts)
    assert packing.pack(docs.limit(0)).count() == 0
    again = packing.pack(spark.createDataFrame([(None, "x y"), (1, "x"), (1, "x")], "doc_id long, text string").coalesce(1)).collect()
    assert len(again) == 3 and len({r["sequence_id"] for r in again}) == 1


# near-duplicates


def plain_classes(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    holders = {}
    for i, s in sets.items():
        near = Counter(j for x in s for j in holders.get(x, ()))
        for j, common in near.items():
            if 100 * common >= percent * (len(s) + len(sets[j]) - common):
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
        for x in s:
            holders.setdefault(x, []).append(i)
    return {i: (len(sets[i]), root(i)) for i in texts}


def classes(df):
    rows = df.collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows if r["doc_id"] is not None)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


def test_neardup_on_the_table(spark):
    assert classes(QUERIES["op5_neardup"](spark, SF)) == plain_classes(documents(spark), 3, 85)


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_neardup_of_a_large_group_at_the_threshold(spark, size, percent):
    rng = np.random.default_rng(size)
    base = [f"w{i}" for i in range(160)]
    texts = {}
    for i in range(140):
        own = list(base)
        for k in rng.integers(0, 160, rng.integers(0, 9)):
            own[k] = f"e{rng.integers(0, 12)}"
        texts[i] = " ".join(own)
    texts |= {200 + i: " ".join(f"u{i}_{k}" for k in range(60)) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert classes(neardup.classes(docs, shingle=size, percent=percent)) == plain_classes(texts, size, percent)


def test_neardup_awkward(spark, awkward):
    rows = neardup.classes(awkward, shingle=3, percent=85).collect()
    assert len(rows) == len(ROWS)
    got = {r["doc_id"]: r for r in rows}
    assert {got[i]["component_id"] for i in (1, 5)} == {1} and got[7]["component_id"] == got[8]["component_id"] == 7
    assert all(got[i]["component_id"] == i and got[i]["n_shingles"] == 0 and got[i]["kept"] for i in (2, 3, 4))
    assert got[None]["component_id"] is None and got[None]["kept"]
    assert neardup.classes(awkward.limit(0)).count() == 0


def test_sketch_estimates_and_merges():
    a, b = np.arange(3000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.arange(600, 3600, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    both = np.union1d(a, b)
    sa, sb, su = neardup.sketch([a, b, both])
    assert (np.maximum(sa, sb) == su).all()
    assert abs((sa == sb).mean() - neardup.agreement(2400 / 3600)) < 0.08
    assert not neardup.may_reach(sa, sb, 3000, 3000, 0.85) and neardup.may_reach(sa, su, 3000, 3600, 0.8)


@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_register_filter_rarely_loses_a_link(spark, monkeypatch, similarity):
    # The filter of classes() itself: as many agreeing registers as it asks for, taken from the expression it builds.
    from math import comb

    asked = []
    monkeypatch.setattr(neardup, "_agree", lambda a, b: type("Agree", (), {"__ge__": lambda self, n: (asked.append(n), F.lit(True))[1]})())
    neardup.classes(spark.createDataFrame([(1, "a b c d"), (2, "a b c e")], "doc_id long, text string"), shingle=1, percent=round(100 * similarity))
    # One set inside the other: the larger alone has 1 - similarity of the union.
    p = 1 + np.log(1 - (1 - similarity) * (neardup.BASE - 1) / neardup.BASE) / np.log(neardup.BASE)
    assert asked and all(sum(comb(512, k) * p**k * (1 - p) ** (512 - k) for k in range(n)) < neardup.MISS for n in asked)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(300, 340)] + [(5, 5)] + [(901, 900)]
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(300, 340))} | {900: 900, 901: 900}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# top-k


def plain_top(vectors, k, query):
    out = set()
    for i, v in vectors:
        if query(i):
            best = sorted((-int(np.dot(v, w)), j) for j, w in vectors if j != i)[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def test_topk_on_the_table(spark):
    vectors = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], float)).astype(np.int64)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = {tuple(r) for r in QUERIES["op6_topk"](spark, SF).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == plain_top(vectors, 5, lambda i: i % 50 == 0)


def test_topk_awkward(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.integers(-300, 300, 6) if i % 3 else np.array([1, 2, 3, 4, 5, 6])) for i in range(90)]
    rows = [(i, [float(x) / 256 for x in v], 0) for i, v in vectors]
    bad = [(200, None, 0), (201, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (202, [float("nan")] * 6, 0), (203, [float("inf")] * 6, 0), (None, [1.0] * 6, 0), (204, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, score int")
    for block, per in ((65_536, 1024), (20, 4)):
        got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0, k=4, block=block, query_block=per).collect()}
        assert got == plain_top(vectors, 4, lambda i: i % 10 == 0)
    few = topk.top_k(df.where("vec_id < 3"), F.lit(True), k=5).collect()
    assert len(few) == 6
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_topk_sums_many_attributes_in_few_calls():
    """A query against a block of some thousand rows takes milliseconds: bitmaps of a weight are added together."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-200, 200, (4000, 64))
    index = topk.Index(np.arange(4000), rows)
    began = time.process_time()
    found = [index.top(q, rows[q], 5) for q in range(40)]
    assert time.process_time() - began < 0.5
    for q, (ids, scores) in enumerate(found):
        best = sorted((-int(s), i) for i, s in enumerate(rows @ rows[q]) if i != q)[:5]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist())] == best
    ids, scores = index.top(-1, np.zeros(64, np.int64), 5)
    assert ids.tolist() == [0, 1, 2, 3, 4] and not scores.any()


# html


def test_html_on_the_table(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op7_html"](spark, SF).collect():
        page = pages[r["page_id"]]
        inner = page[page.index("<article>"):page.index("</article>")]
        blocks = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_html_of_unseen_pages(spark):
    page = """<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body>
    <div class="top-menu"><a href="/">Start</a><a href="/n">News</a></div><div class="cookie-notice">Cookies are used here.</div>
    <main><h1>A title &amp; more</h1><p>First   paragraph
    of the <a href=x>story</a> &lt;here&gt;.</p><p>Second one.<div class="advert">Buy now, buy cheap.</div><p>Third &#233;nd.</main>
    <section id="comments"><p>First! I liked the story very much.</p></section><form><p>Leave a reply</p><textarea>x</textarea></form>
    <footer>&copy; us</footer></body></html>"""
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (None, "u", "<p>unclosed <b>'quote"), (4, "u", "<div class=x" * 50), (5, "u", "plain & simple"), (1, "u", page), (6, "u", "<p>" + LONG)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract(df).collect()
    assert [r["text"] for r in got if r["page_id"] == 1] == ["A title & more\nFirst paragraph of the story <here>.\nSecond one.\nThird énd."] * 2
    assert all(r["text"] == "" and r["n_chars"] == 0 for r in got if r["page_id"] in (2, 3))
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "page",
    ["<div class=x" * 90_000, "<div>t" * 50_000, '<a x="' * 160_000, '<a "" ' * 80_000 + '">"', "<script>a" + "</script" * 100_000, "<div>" * 3000 + "</x>" * 100_000, "<" * 500_000, "<!-- <a" * 100_000, "<div class=x" * 80_000 + '"'],
)
def test_html_of_broken_pages_takes_time_in_proportion(page):
    import time

    began = time.time()
    found = html.blocks(page)
    assert time.time() - began < 10 and sum(len(b.text) for b in found) <= len(page)


def test_html_tags_end_where_they_should():
    seen = lambda page: [(b.text, b.own) for b in html.blocks(page)]
    assert seen("<p title='a>b'>x</p>y") == [("x", "p"), ("y", "")]
    assert seen("<p title='a>x</p>y") == [("x", "p"), ("y", "")]
    assert seen("a <3 b<!-- <p> -->c<!x>d<?y>e") == [("a <3 bcde", "")]
    assert seen("<div>a<script>if (a<b) '<p>'</script>b</div><!-- open <p>c") == [("a", "div"), ("b", "div")]
    assert seen("<div class=x<p>t") == [("t", "div")]


def test_html_decoding_is_the_best_labelling():
    field = html.Field({"a": 1.5, "b": -2.0, "c": 0.3}, np.array([[0.5, -0.7], [-0.4, 0.6]]))
    rng = np.random.default_rng(5)
    for _ in range(40):
        feats = [[("a", "b", "c")[k] for k in rng.integers(0, 3, 2)] for _ in range(6)]

        def worth(labels, feats=feats):
            return sum(sum(field.weights[x] for x in f) for f, y in zip(feats, labels) if y) + sum(field.moves[p, q] for p, q in zip(labels, labels[1:]))

        best = max(worth([m >> i & 1 for i in range(6)]) for m in range(64))
        assert abs(worth(field.decode(feats)) - best) < 1e-9


# languages


def test_langid_held_out_accuracy(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op8_langid"](spark, SF).collect() if r["held_out"]]
    assert rows and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_langid_is_the_out_of_place_distance():
    profiles = langid.Profiles([("a", int(g), k) for k, g in enumerate(langid.ranked(langid.grams("abab ab ba"), 5))] + [("b", int(g), k) for k, g in enumerate(langid.ranked(langid.grams("xyxy xy yx"), 5))], 5)
    assert profiles.predict("abab ab ba") == ("a", 1.0)
    assert profiles.predict("qq qq") == ("a", 0.5)
    assert profiles.predict("12 !") == ("und", 0.0) and profiles.predict(None) == ("und", 0.0)


def test_langid_awkward(spark, awkward):
    profiles = langid.train(awkward, F.col("doc_id") > 0)
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.predict(awkward, profiles).collect()]
    assert len(got) == len(ROWS) and {p for i, p in got if i in (2, 3, 4, 9)} == {"und"} and all(p != "und" for i, p in got if i in (1, 5, 7, 10, None))
    kept = langid.keep_identified(awkward, profiles)
    assert kept.columns == awkward.columns and kept.count() == len(ROWS) - 4
    empty = langid.train(awkward.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(awkward, empty).collect()} == {"und"}


# personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def plain_spans(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found)


def agrees(rows, texts):
    for r in rows:
        want = plain_spans(texts[r["doc_id"]])
        written = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        counts = Counter(k for _, k, _ in want)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [counts[k] for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(",".join(written).encode()).hexdigest(), r
        assert set(written) <= set(r["spans"].split(",")) or not written


def test_pii_on_the_table(spark):
    rows = QUERIES["op9_pii"](spark, SF).collect()
    texts = documents(spark)
    assert len(rows) == len(texts)
    agrees(rows, texts)


def test_pii_awkward(spark):
    texts = dict(enumerate([
        None, "", "a@b.c%x@d.e and a@b.c", "x@y x@y.z. @a.b ü\U0001F600 é@q.rs", "1.2.3.4.5.6.7.8 256.1.1.1 000255.01.1.1 1.2.3", "4111 1111 1111 1111, 4111-1111-1111-1112 12345678901234567890",
        "+1 (555) 123-4567 +1 2 +12345678901234567 ++49 30 1234567", "9" * 30_000, "1.1" * 3000, "a@" + "b." * 20_000 + "c", "no data", "\U0001F600" * 50 + " a.b@c.de +49 30 5550182",
        "card 4012 8888 8888 1881 and 10.0.0.1", "+" * 500 + "1" * 12,
    ]))
    docs = spark.createDataFrame([(i, t, "clash", 3) for i, t in texts.items()], "doc_id long, text string, base string, start int")
    agrees(pii.detect(docs).collect(), texts)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert clean[0] is None and clean[1] == "" and clean[10] == "no data"
    assert clean[11] == "\U0001F600" * 50 + " [EMAIL] [PHONE]" and clean[12] == "card [CARD] and [IP]"
    assert pii.redact(docs).columns == docs.columns
    assert pii.detect(docs.limit(0)).count() == 0


def test_pii_adds_by_the_trees(spark):
    texts = {1: "call me at 555-123-4567 now", 2: "write to jane.roe at mail dot com", 3: "order 555-123-4567 came", 4: "see section 1 . 2 . 3 . 4", 5: "the quick brown fox, version 2.0."}
    got = {r["doc_id"]: r["spans"] for r in pii.detect(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {1: "phone:11:23", 2: "email:9:33", 3: "", 4: "", 5: ""}


# decontamination


def test_decontamination_on_the_table(spark):
    items = {r["item_id"]: shingles(r["text"], 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    want = set()
    for doc_id, text in documents(spark).items():
        own = shingles(text, 5)
        want |= {(doc_id, i, len(s), len(s & own)) for i, s in items.items() if len(s & own) >= 0.8 * len(s) - 1e-9}
    got = {tuple(r)[:4] for r in QUERIES["op10_decontamination"](spark, SF).collect()}
    assert got == want and want


def test_decontamination_awkward(spark, awkward):
    item = " ".join(f"q{i}" for i in range(40))
    holed = " ".join(f"q{i}" if i not in (3, 30) else "z" for i in range(40))
    long = spark.createDataFrame([(50, LONG + item + " " + LONG), (51, LONG + holed), (51, LONG + holed), (52, item.upper().replace(" ", "\n"))], "doc_id long, text string")
    docs = awkward.select("doc_id", "text").union(long).withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(1, item, "c"), (2, None, "c"), (3, "", "c"), (4, "two words", "c"), (None, item, "c"), (1, item, "c")], "item_id long, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontaminate.contaminated(docs, items, share=0.7).collect()}
    assert got == {(50, 1): 1.0, (51, 1): 27 / 36, (52, 1): 1.0, (7, 4): 1.0, (8, 4): 1.0}
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 and decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_of_short_items_and_of_texts_under_one_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "pq")
    docs = spark.createDataFrame([(1, LONG + "Red\nhat " + LONG), (2, LONG + "red green hat"), (3, LONG + one), (4, two + " " + LONG), (5, "hat"), (6, f"{one} {two} a b c d red hat")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "red hat"), (2, one), (2, two), (3, "a b c d"), (4, "hat"), (4, "a b c d red hat")], "item_id long, text string")
    got = {tuple(r) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 1, 1, 1.0), (6, 1, 1, 1, 1.0), (3, 2, 26, 26, 1.0), (4, 2, 26, 26, 1.0), (6, 2, 26, 26, 1.0), (6, 3, 1, 1, 1.0),
                   (1, 4, 1, 1, 1.0), (2, 4, 1, 1, 1.0), (5, 4, 1, 1, 1.0), (6, 4, 2, 2, 1.0)}


def test_missing_minima_are_rare():
    from math import comb

    for _, orders in decontaminate.PARTITIONS:
        least = decontaminate.needed(orders, 0.8)
        assert 1 <= least < orders and sum(comb(orders, k) * 0.8**k * 0.2 ** (orders - k) for k in range(least)) <= decontaminate.MISS

"""Token ids read side by side equal the tokenizer's own, and distinct words cost less than one call each."""

from __future__ import annotations

import heapq
import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from returnlens.llm import packing
from returnlens.llm.tokens import Tokens

WORDS, BYTES = (public_tokenizers.path(f"{name}.json") for name in ("word_bpe_49k", "byte_bpe_50k"))
SIGNS = "aAbesStTrRvVmMlLdD''''..,,!?-–—“”’«»ÉéñΣσςİıßﬁÅKé̀ \t\n\r\x0b\x0c\x85\xa0 ​　﻿09٣½²Ⅷ日本語。한글क्षि😀🏽\x00\x1c\x1f\x7f<|>_()[]\"$%&*@#/\\"


def same(path, texts):
    flat, counts = Tokens(path, 1).ids(pa.array(texts, pa.string()))
    plain, at = Tokenizer.from_file(path), 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert flat[at:at + n].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 1], ascii(text)
        at += n
    assert at == len(flat)


@pytest.mark.parametrize("alphabet", [SIGNS, "".join(map(chr, range(1, 128))), "etaoinshrdlu'. "])
def test_random_texts(alphabet):
    r = random.Random(1)
    same(WORDS, ["".join(r.choices(alphabet, k=r.randint(0, 60))) for _ in range(5000)])


def test_letters_of_every_script():
    letters = [chr(c) for c in range(0xAA, 0x32000, 7) if chr(c).isalpha()]
    same(WORDS, [t for c in letters for t in (f"a{c}b", f"({c}), É{c}.")])


def test_lengths_and_odd_texts():
    same(WORDS, [c * n for c in ("x", "ab", "é", "日", "1", ".") for n in range(0, 100, 3)])
    same(WORDS, [None, "", " ", "aaaa" * 5000, "a<|endoftext|>b", "\x1c", "a\x1fb", "Å", "don't I'M '90s rock'n'roll", None])
    same(WORDS, [])
    same(WORDS, ["<|startoftext|>"] * 2)


def test_a_tokenizer_that_keeps_white_space(spark):
    text = "Two  spaces\nand it's  done "
    same(BYTES, [text, None, ""])
    row = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string"), tokenizer=BYTES).collect()[0]
    assert row["doc_tokens"] == len(Tokenizer.from_file(BYTES).encode(text, add_special_tokens=False).ids) + 1


def test_distinct_words_cost_less_than_a_call_each():
    r = random.Random(2)
    words = list({"".join(r.choices(("an", "er", "ing", "sth", "ou", "re", "tion", "ble"), k=r.randint(4, 7))) for _ in range(100_000)})
    texts = pa.array([" ".join(words[i:i + 100]) + "." for i in range(0, len(words), 100)])
    tokens = Tokens(WORDS, 1)

    def cost(ready, work):
        took = []
        for _ in range(3):
            given = ready()
            began = time.process_time()
            work(given)
            took.append(time.process_time() - began)
        return min(took)

    alone = cost(lambda: Tokenizer.from_file(WORDS).model, lambda model: [[t.id for t in model.tokenize(w)] for w in words])
    assert cost(lambda: texts, tokens.ids) < 0.75 * alone
    assert "tokenizer" not in vars(tokens)  # it was not even loaded


def plain_differencing(sizes, ways):
    heap = [(-size, i, np.array([0] * (ways - 1) + [size]), [()] * (ways - 1) + [(i,)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for serial in range(len(sizes), 2 * len(sizes) - 1):
        (_, _, a, pa_), (_, _, b, pb) = heapq.heappop(heap), heapq.heappop(heap)
        order = np.argsort(a + b[::-1], kind="stable")
        sums, parts = (a + b[::-1])[order], [(x + y) for x, y in zip(pa_, reversed(pb), strict=True)]
        heapq.heappush(heap, (-int(sums[-1] - sums[0]), serial, sums - sums[0], [parts[k] for k in order]))
    return [sorted(p) for p in heap[0][3]]


@pytest.mark.parametrize("count, ways", [(1, 1), (1, 4), (2, 3), (300, 7), (500, 64), (400, 300)])
def test_differencing_as_written_out(count, ways):
    sizes = np.random.default_rng(count).integers(1, 257, count).tolist()
    assert packing.differencing(sizes, ways) == plain_differencing(sizes, ways)
    assert packing.differencing([5] * count, ways) == plain_differencing([5] * count, ways)

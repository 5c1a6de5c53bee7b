"""Token ids of many texts at once.

Texts are cut at white space, and each distinct chunk of a slice of texts is cut into the tokenizer's pieces once. The
distinct pieces are merged side by side in arrays, and every text's ids are then copied from those of its chunks. Nothing is
kept between slices, so memory goes with one slice. Chunks that mix signs with letters beyond ASCII are cut by the tokenizer's
own steps. Texts that spell a special token or hold a separator on which Arrow and the tokenizer disagree go through the
tokenizer whole, and so does every text if the tokenizer is built differently.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_WORDS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _WORDS}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}
_PLAIN = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}
_ODD = "[\x1c-\x1f]|<\\|"
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\sa-z0-9]+")  # the tokenizer's own, within ASCII
_AFTER = string.punctuation + "«»“”„‘’…–—、。！？（）"  # in any row one piece of the tokenizer, beside letters
_BEFORE = _AFTER.replace("'", "")  # an apostrophe in front may take letters with it
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SPELLED = [chr(b if b in _VISIBLE else 256 + b - sum(v < b for v in _VISIBLE)) for b in range(256)]  # bytes as the vocabulary writes them


def spans(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The given stretches of ``flat`` after each other."""
    ends = np.cumsum(lengths)
    return flat.take(np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0))


def _flags(x: pa.BooleanArray) -> np.ndarray:
    return np.array(x.to_numpy(zero_copy_only=False), bool)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large text array."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return at, np.frombuffer(data or b"", np.uint8)


def merges_words(settings: dict) -> bool:
    """Whether a tokenizer drops white space, merges bytes inside words only and knows every byte, as the public word tokenizer."""
    model = settings["model"]
    return (
        settings["normalizer"] == _NORMALIZER and settings["pre_tokenizer"] == _PRE_TOKENIZER and not settings["truncation"] and not settings["padding"]
        and all(model.get(k) == v for k, v in _PLAIN.items()) and bool(model["end_of_word_suffix"])
        and all(c + end in model["vocab"] for c in _SPELLED for end in ("", model["end_of_word_suffix"]))
        and all(t["content"].startswith("<|") and not (t["normalized"] or t["lstrip"]) for t in settings["added_tokens"])
    )


class Merges:
    """Byte-pair merges of many words side by side, each in the order of the tokenizer's model: lowest rank first, then leftmost.

    All words of n symbols take one merge together and meet the words of n - 1 bytes, from the longest down.
    """

    LONGEST, BLOCK = 64, 1 << 15

    def __init__(self, settings: dict, tokenize):
        vocab, end = settings["vocab"], settings["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in settings["merges"]]
        self.tokenize = tokenize
        kind = np.uint16 if max(len(pairs), *vocab.values()) < 0xFFFF else np.uint32
        self.first = np.array([vocab[c] for c in _SPELLED], kind)
        self.last = np.array([vocab[c + end] for c in _SPELLED], kind)
        self.made = np.array([vocab[a + b] for a, b in pairs], kind)
        self.none = np.iinfo(kind).max  # the rank of pairs without a merge
        self.bits = (4 * len(pairs) + 16).bit_length()
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, self.none, kind)
        keys = self._key(np.array([vocab[a] for a, _ in pairs], np.int64), np.array([vocab[b] for _, b in pairs], np.int64))
        slots, left = self._slot(keys), np.arange(len(pairs))
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            taken, which = np.unique(slots[free], return_index=True)
            self.keys[taken], self.ranks[taken] = keys[free[which]], free[which]
            left = np.setdiff1d(left, free[which], assume_unique=True)
            slots[left] = (slots[left] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (((keys ^ keys >> 17).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, ``none`` without one."""
        keys = self._key(left, right)
        slots = self._slot(keys)
        there = self.keys.take(slots)
        out = np.where(there == keys, self.ranks.take(slots), self.ranks.dtype.type(self.none))
        todo = np.nonzero((there != keys) & (there >= 0))
        while len(todo[0]):
            slots[todo] = (slots[todo] + 1) & (len(self.keys) - 1)
            there = self.keys[slots[todo]]
            same = there == keys[todo]
            out[tuple(x[same] for x in todo)] = self.ranks[slots[tuple(x[same] for x in todo)]]
            todo = tuple(x[~same & (there >= 0)] for x in todo)
        return out

    def _block(self, data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray):
        """Words of up to ``LONGEST`` bytes: their numbers and ids, by the count of ids."""
        who, ids, rank = np.zeros(0, np.int64), None, None
        for k in range(int(sizes.max(initial=0)), 0, -1):
            new = np.flatnonzero(sizes == k)
            at = data[offsets[new] + np.arange(k)[:, None]]
            fresh = np.concatenate([self.first.take(at[:-1]), self.last.take(at[-1:])])
            weights = self.rank(fresh[:-1], fresh[1:])
            who = np.concatenate([who, new])
            ids, rank = (np.hstack([ids, fresh]), np.hstack([rank, weights])) if ids is not None else (fresh, weights)
            if k == 1:
                yield who, ids
                return
            best = rank.min(axis=0)
            done, go = np.flatnonzero(best == self.none), np.flatnonzero(best < self.none)
            if len(done):
                yield who[done], ids.take(done, axis=1)
                who, ids, rank, best = who[go], ids.take(go, axis=1), rank.take(go, axis=1), best[go]
            step = np.arange(k - 1, dtype=np.uint8)[:, None]
            at = k - 1 - ((rank == best) * (k - 1 - step)).max(axis=0)  # the leftmost of the lowest
            before = np.negative((step < at).astype(ids.dtype))  # all bits where a symbol keeps its place
            at, merged = at.astype(np.int64), self.made.take(best)
            ids = ids[1:] ^ ((ids[:-1] ^ ids[1:]) & before)
            ids[at, np.arange(len(at))] = merged
            rank = rank[1:] ^ ((rank[:-1] ^ rank[1:]) & before[:-1])
            x = np.flatnonzero(at > 0)
            rank[at[x] - 1, x] = self.rank(ids[at[x] - 1, x], merged[x])
            x = np.flatnonzero(at < k - 2)
            rank[at[x], x] = self.rank(merged[x], ids[at[x] + 1, x])

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of every word's ids, and the ids; ``words`` is a large text array."""
        offsets, data = _buffers(words)
        sizes, lengths, found = np.diff(offsets), np.zeros(len(words), np.int64), []
        for begin in range(0, len(words), self.BLOCK):
            block = sizes[begin:begin + self.BLOCK]
            for who, ids in self._block(data, offsets[begin:begin + self.BLOCK], np.where(block <= self.LONGEST, block, 0)):
                found.append((who + begin, ids))
                lengths[who + begin] = len(ids)
        for i in np.flatnonzero(sizes > self.LONGEST):
            ids = np.array(self.tokenize("".join([_SPELLED[b] for b in data[offsets[i]:offsets[i + 1]].tolist()])))[:, None]
            found.append((np.array([i]), ids))
            lengths[i] = len(ids)
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), "<u4")
        for who, ids in found:
            flat[starts[who] + np.arange(len(ids))[:, None]] = ids
        return starts, lengths, flat


def _cut(texts: pa.Array, begins: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The given bytes of every text, as texts."""
    texts = texts.cast(pa.large_string())
    offsets, data = _buffers(texts)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(ends), pa.py_buffer(spans(data, offsets[:-1] + begins, sizes)))


class Tokens:
    """Token ids of texts, each with an id of its own at the end."""

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, normalizers, pre_tokenizers

        with open(path, encoding="utf-8") as file:
            self.written = file.read()
        settings = json.loads(self.written)
        self.end, self.letters, self.merges = np.array([end], "<u4"), {" ": True}, None
        if merges_words(settings):
            self.merges = Merges(settings["model"], lambda word: [t.id for t in self.tokenizer.model.tokenize(word)])
            self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\\s+"), " "), normalizers.Lowercase()])
            self.splitter = pre_tokenizers.Split(Regex(_WORDS), "removed", invert=True)

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.written)

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _pieces(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return _PIECE.findall(chunk.lower())
        return [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))]

    def _letter(self, c: str) -> bool:
        """Whether the tokenizer takes a character as a letter, with the lower case that Arrow gives it."""
        if c not in self.letters:
            small = self.normalizer.normalize_str(c)
            self.letters[c] = c.isalpha() and len(self._pieces(f"a{c}a")) == 1 and small == pc.utf8_lower(pa.scalar(c)).as_py()
        return self.letters[c]

    def _covered(self, words: list[str]) -> list[bool]:
        """Which words of letters beyond ASCII stay as they are but for lower case."""
        joined = " ".join(words)
        if all([self._letter(c) for c in set(joined)]) and unicodedata.is_normalized("NFC", joined):
            return [True] * len(words)
        return [all(map(self._letter, w)) and unicodedata.is_normalized("NFC", w) for w in words]

    def _chunks(self, chunks: pa.Array, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and length of the ids of every chunk, of every text of ``texts`` and of the end, and the ids."""
        inner = pc.utf8_ltrim(chunks, _BEFORE)
        core = pc.utf8_rtrim(inner, _AFTER)
        word = pc.utf8_lower(core)
        plain = _flags(pc.utf8_is_alpha(word))
        foreign = np.flatnonzero(plain & ~_flags(pc.string_is_ascii(core)))
        plain[foreign] = self._covered(core.take(pa.array(foreign)).to_pylist())

        # a plain chunk is a word with signs around it, any other a chain of pieces
        size, inside, kept = (pc.binary_length(x).to_numpy().astype(np.int64)[plain] for x in (chunks, inner, core))
        before, after = size - inside, inside - kept
        signed = chunks.filter(pa.array(plain))
        front, back = np.flatnonzero(before), np.flatnonzero(after)
        found = [self._pieces(c) for c in chunks.filter(pa.array(~plain)).to_pylist()]
        groups = [
            word.filter(pa.array(plain)), _cut(signed.take(pa.array(front)), np.zeros(len(front), np.int64), before[front]),
            _cut(signed.take(pa.array(back)), (size - after)[back], after[back]), pa.array([p for f in found for p in f], pa.string()),
        ]
        pieces = pa.concat_arrays([x.cast(pa.large_string()) for x in groups]).dictionary_encode()
        words, fronts, backs, rest = np.split(pieces.indices.to_numpy(), np.cumsum([len(x) for x in groups])[:-1])

        counts = np.concatenate([1 + (before > 0) + (after > 0), np.array([len(f) for f in found], np.int64)])
        ends = np.cumsum(counts)
        chain = np.empty(counts.sum(), np.int64)
        first = (ends - counts)[:len(words)]
        chain[first[front]] = fronts
        chain[first + (before > 0)] = words
        chain[ends[back] - 1] = backs
        chain[len(chain) - len(rest):] = rest
        starts, lengths, flat = self.merges.ids(pieces.dictionary)
        sizes = lengths.take(chain)
        counts = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], ends])])

        whole = [self._whole(t) for t in texts]
        counts = np.concatenate([counts, np.array([len(x) for x in whole], np.int64), [1]])
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain), len(chunks) + np.arange(len(texts) + 1)])
        begins, spread = np.empty_like(counts), np.empty_like(counts)
        begins[order], spread[order] = np.cumsum(counts) - counts, counts
        return begins, spread, np.concatenate([spans(flat, starts.take(chain), sizes), *whole, self.end])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts after each other, and how many each has; a null is an empty text."""
        texts = texts.fill_null("")
        if self.merges is None:
            found = [np.concatenate([self._whole(t), self.end]) for t in texts.to_pylist()]
            return np.concatenate([self.end[:0], *found]), np.array([len(x) for x in found], np.int64)
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = lists.values.dictionary_encode()
        odd = _flags(odd)
        starts, lengths, flat = self._chunks(coded.dictionary, texts.filter(pa.array(odd)).to_pylist())
        # an odd text's place is that of its only chunk, an empty one; the end follows every text
        ends = lists.offsets.to_numpy()[1:].astype(np.int64)
        chain = np.insert(
            coded.indices.to_numpy(), np.concatenate([ends[odd], ends]),
            np.concatenate([len(coded.dictionary) + np.arange(odd.sum()), np.full(len(ends), len(starts) - 1)]).astype(np.int32),
        )
        sizes = lengths.take(chain)
        totals = np.cumsum(sizes)[ends + np.cumsum(odd) + np.arange(len(ends))]
        return spans(flat, starts.take(chain), sizes), np.diff(totals, prepend=0)

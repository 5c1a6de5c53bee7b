"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: runs of text between block-level tags. A block is described by its ancestors' tags, the
words of their class, id and role attributes, and by its text; neighbours are tied by transition weights. The field is
trained on labelled pages on the driver (a small table, built in below or given) and decoded with Viterbi, page by page,
in a map over the rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile(r"[\"'>]")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: Elements whose content is not text of the page.
UNSEEN = {"script", "style", "title", "noscript", "template", "svg", "math", "iframe", "object", "head", "textarea"}
_RAW = {"script", "style", "title", "noscript", "template", "svg", "iframe", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
    "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}


class Block:
    __slots__ = ("marks", "own", "text", "linked")

    def __init__(self, marks: frozenset[str], own: str, text: str, linked: int):
        self.marks, self.own, self.text, self.linked = marks, own, text, linked


class Scanner:
    """Tags of a page in one forward scan, whatever is left open in it.

    A tag ends at the first ``>`` outside quotes; if there is none, at the first ``>`` at all; if there is none either, it is
    text. Where a search has found nothing is remembered, so no stretch of the page is searched again and again: the last
    place of each sign, the sign that comes next, and the opening quotes from which no end was reached.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {sign: page.rfind(sign) for sign in "\"'>"}
        self.after, self.stop = 0, -1  # no sign lies between ``after`` and ``stop``
        self.doomed: set[int] = set()

    def _next_stop(self, at: int) -> int:
        if not self.after <= at <= self.stop:
            found = _STOP.search(self.page, at) if at <= max(self.last.values()) else None
            self.after, self.stop = at, found.start() if found else len(self.page)
        return self.stop

    def _tag_end(self, at: int) -> int:
        """Where a tag with its name before ``at`` has its ``>``, or -1."""
        start, tried = at, []
        while True:
            stop = self._next_stop(at)
            if stop < len(self.page) and self.page[stop] == ">":
                return stop
            sign = self.page[stop:stop + 1]
            if not sign or stop in self.doomed or self.last[sign] <= stop:
                break
            tried.append(stop)
            at = self.page.index(sign, stop + 1) + 1
        self.doomed.update(tried)
        return self.page.index(">", start) if self.last[">"] >= start else -1

    def tags(self):
        """Yields (start, end, name or '', closing, attributes); a page may jump ahead by sending a new place."""
        page, at = self.page, 0
        while (at := page.find("<", at)) >= 0:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                found = (at, len(page) if end < 0 else end + 3, "", "", "")
            elif page[at + 1:at + 2] in ("!", "?"):
                found = (at, page.index(">", at) + 1, "", "", "") if self.last[">"] > at else None
            else:
                name = _NAME.match(page, at)
                end = self._tag_end(name.end()) if name else -1
                found = (at, end + 1, name[2].lower(), name[1], page[name.end():end]) if end >= 0 else None
            if found is None:
                at += 1
                continue
            jump = yield found
            at = found[1]
            if jump is not None:
                at = max(at, jump)
                yield None

    def end_of(self, name: str, at: int) -> int:
        """Where the next closing tag of this name ends; the end of the page if there is none."""
        found = re.compile(rf"</{name}\b[^>]*>", re.I).search(self.page, at, self.last[">"] + 1) if self.last[">"] >= at else None
        return found.end() if found else len(self.page)


@lru_cache(4096)
def _marks(tag: str, attributes: str) -> frozenset[str]:
    """What an element tells about the blocks inside it: its tag and the words it is named by."""
    words = {w for m in _NAMES.finditer(attributes) for w in _WORD.findall((m[1] or m[2] or m[3] or "").lower())}
    return frozenset((tag, *(f".{w}" for w in words)))


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, without those that hold white space only."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []  # an open element and the marks of all elements it lies in
    opened: Counter[str] = Counter()
    pieces: list[str] = []
    linked, anchors, at = 0, 0, 0

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(entities.unescape("".join(pieces)).split())
            if text:
                found.append(Block(stack[-1][1] if stack else frozenset(), stack[-1][0] if stack else "", text, linked))
            pieces.clear()
        linked = 0

    def pop() -> str:
        tag, _ = stack.pop()
        opened[tag] -= 1
        return tag

    scanner = Scanner(page)
    tags = scanner.tags()
    for start, end, tag, closing, attributes in tags:
        if start > at:
            pieces.append(page[at:start])
            if anchors:
                linked += start - at
        at = end
        if not tag:
            continue
        if tag in _RAW and not closing:
            close()
            at = scanner.end_of(tag, end)
            tags.send(at)
            continue
        if tag in INLINE:
            if tag == "br":
                pieces.append(" ")
            elif tag == "a":
                anchors = 0 if closing else 1
            continue
        close()
        if closing:
            if opened[tag] > 0:
                while pop() != tag:
                    pass
            anchors = 0
            continue
        if stack and stack[-1][0] == tag and tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            pop()
        elif stack and stack[-1][0] == "p":
            pop()
        if tag == "head" or tag in VOID or attributes.rstrip().endswith("/"):
            continue
        around, own = stack[-1][1] if stack else frozenset(), _marks(tag, attributes)
        stack.append((tag, around if own <= around else around | own))
        opened[tag] += 1
    if at < len(page):
        pieces.append(page[at:])
        if anchors:
            linked += len(page) - at
    close()
    return found


def described(page: list[Block]) -> list[list[str]]:
    """Features of every block of a page."""
    out = []
    for i, b in enumerate(page):
        f = ["bias"] + [f"in {m}" for m in b.marks]
        f.append(f"own {b.own}")
        size = len(b.text)
        f.append("tiny" if size < 25 else "short" if size < 80 else "long" if size < 300 else "very long")
        if b.linked * 2 > size:
            f.append("links")
        if b.text[-1] in ".!?":
            f.append("ends as a sentence")
        if "©" in b.text or "all rights reserved" in b.text.lower():
            f.append("rights")
        if i == 0:
            f.append("first")
        if i == len(page) - 1:
            f.append("last")
        out.append(f)
    return out


class Field:
    """Two labels, 1 for main text. ``weights`` score label 1; ``moves[a, b]`` scores b after a."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def decode(self, feats: list[list[str]]) -> list[int]:
        (a, b), (c, d) = self.moves.tolist()
        get = self.weights.get
        off = on = 0.0
        back = []
        for t, f in enumerate(feats):
            own = sum(get(x, 0.0) for x in f)
            if t == 0:
                off, on = 0.0, own
                continue
            to_off, to_on = (off + a >= on + c), (off + b > on + d)
            back.append((0 if to_off else 1, 0 if to_on else 1))
            off, on = max(off + a, on + c), max(off + b, on + d) + own
        if not feats:
            return []
        label = int(on > off)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[str, list[str]]], steps: int = 120, rate: float = 0.5, decay: float = 0.001) -> Field:
    """Maximum conditional likelihood with an L2 penalty, by AdaGrad over (html, main blocks) pages."""
    data = []
    for page, main in pages:
        found = blocks(page)
        wanted = set(main)
        data.append((described(found), [int(b.text in wanted) for b in found]))
    names = {f: i for i, f in enumerate(sorted({x for feats, _ in data for f in feats for x in f}))}
    coded = [([np.array([names[x] for x in f]) for f in feats], np.array(labels)) for feats, labels in data if feats]
    w, moves = np.zeros(len(names)), np.zeros((2, 2))
    gw, gm = np.full(len(names), 1e-3), np.full((2, 2), 1e-3)
    for _ in range(steps):
        dw, dm = -decay * w, -decay * moves
        for feats, labels in coded:
            n = len(feats)
            own = np.zeros((n, 2))
            own[:, 1] = [w[f].sum() for f in feats]
            fwd, bwd = own.copy(), np.zeros((n, 2))
            for t in range(1, n):
                fwd[t] += np.logaddexp(fwd[t - 1, 0] + moves[0], fwd[t - 1, 1] + moves[1])
            for t in range(n - 2, -1, -1):
                ahead = own[t + 1] + bwd[t + 1]
                bwd[t] = np.logaddexp(moves[:, 0] + ahead[0], moves[:, 1] + ahead[1])
            z = np.logaddexp(*fwd[-1])
            miss = labels - np.exp(fwd[:, 1] + bwd[:, 1] - z)
            for f, m in zip(feats, miss, strict=True):
                dw[f] += m
            for t in range(1, n):
                dm -= np.exp(fwd[t - 1][:, None] + moves + (own[t] + bwd[t])[None, :] - z)
                dm[labels[t - 1], labels[t]] += 1
        gw += dw * dw
        gm += dm * dm
        w += rate * dw / np.sqrt(gw)
        moves += rate * dm / np.sqrt(gm)
    return Field({f: float(w[i]) for f, i in names.items()}, moves)


def labelled_pages() -> list[tuple[str, list[str]]]:
    """The built-in labelled pages: a main part and surrounding parts, put together in many ways."""
    body = [
        "The river had risen in the night and the lower fields were under water.", "Nobody in the village could remember a winter like it.",
        "A short note.", "By noon the road to the mill was closed, and the ferry with it. People carried what they could up the hill, to the school, where the doors stood open and soup was being made.",
        "She counted the boats", "Ende gut, alles gut.", "On en parle encore aujourd'hui, dit-il, et pas seulement au marché.", "Todo estaba en silencio.",
        "One.", "What remained was mud, a good deal of it, and the long work of putting things back where they had been before.",
    ]
    before = [
        "<nav><ul><li><a href='/a'>Home</a></li><li><a href='/b'>About us</a></li><li><a href='/c'>Contact</a></li></ul></nav>",
        "<header><a href='/'>The Daily River</a><p>News of the valley since 1890.</p></header>",
        "<div class='ad'>Buy two boats and get one free today.</div>",
        "<div class='cookie-notice'><p>We use cookies to improve this page.</p><button>Accept</button></div>",
        "<div id='menu' class='menu'><a href='/x'>Sport</a> <a href='/y'>Weather</a></div>",
        "<form action='/s'><label>Search</label><input name='q'><button>Go</button></form>",
        "<div class='banner notice'>This site is being rebuilt.</div>",
        "<div class='breadcrumb'><a href='/'>Start</a> <a href='/n'>News</a></div>",
        "<div role='navigation'><a href='/1'>One</a><a href='/2'>Two</a></div>",
    ]
    after = [
        "<footer>&copy; river.example. All rights reserved.</footer>", "<footer><p>Imprint and terms.</p></footer>",
        "<aside><h3>Most read</h3><ul><li><a href='/m'>Ten boats for spring</a></li></ul></aside>",
        "<div class='sidebar'><p>Subscribe to our letter and never miss a story.</p></div>",
        "<section class='comments'><h3>Comments</h3><div class='comment'><p>I was there and it was worse than you say.</p></div></section>",
        "<div id='comments'><p>Great article, thank you.</p><form><textarea></textarea><button>Send</button></form></div>",
        "<div class='related'><a href='/r'>Read also</a></div>", "<div class='share social'><a href='/t'>Share this</a></div>",
        "<div class='newsletter promo'><p>Get the letter every Friday.</p></div>", "<div class='advert sponsored'>A word from our sponsor.</div>",
        "<div class='footer'><p>Printed on paper.</p></div>", "<p class='disclaimer notice'>Opinions are those of their authors.</p>",
    ]
    names = [
        "ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner", "cookie", "notice", "alert", "sidebar", "menu", "nav", "navbar",
        "header", "footer", "related", "share", "social", "comments", "comment", "replies", "newsletter", "subscribe", "signup", "popup",
        "breadcrumb", "widget", "disclaimer", "login",
    ]
    # Surroundings that only their names tell from the story.
    plain = [
        "Boats are sold here at good prices.", "It was a fine day, as all days are.", "Read more of it tomorrow.", "The writer of these lines has seen it, and so have we, more than once and at some length.",
    ]
    named = [
        (f"<div class='{n}'>{{}}</div>", f"<section id='{n}'><p>{{}}</p></section>", f"<aside class='{n}'><p>{{}}</p></aside>", f"<p class='{n}'>{{}}</p>")[i % 4].format(plain[i % len(plain)])
        for i, n in enumerate(names)
    ] + [f"<div class='{n}'>{plain[(i + 1) % len(plain)]}</div>" for i, n in enumerate(names)]
    shells = [
        ("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<div class='content'>", "</div>"),
        ("<div id='main-content' class='post'>", "</div>"), ("<main>", "</main>"), ("<article class='story'><div class='entry body text'>", "</div></article>"),
        ("<div role='main'>", "</div>"), ("<article>", "</article>"),
    ]
    forms = ["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<h2>{}</h2>", "<div>{}</div>", "<p><b>{}<br>", "<p>{} </p>"]
    pages = []
    for k in range(120):
        opened, closed = shells[k % len(shells)]
        count = 1 + (k * 5) % 7
        main = [body[(k + 3 * i) % len(body)] for i in range(count)]
        parts = [f"<h1>{main[0]}</h1>"] + [forms[(k + i) % len(forms) if k % 3 else 0].format(t) for i, t in enumerate(main[1:])]
        if k % 2 == 0:
            inner = after[1 + (k // 2) % (len(after) - 1)]
            if not inner.startswith("<footer"):
                parts.insert(1 + k % len(parts), inner)
        parts.insert(1 + (k // 2) % len(parts), named[(7 * k) % len(named)])
        head = f"<!DOCTYPE html><html lang='en'><head><meta charset='utf-8'><title>{main[0]}</title><style>p{{margin:0}}</style></head><body>"
        top = "".join(before[(k + 2 * i) % len(before)] for i in range(1 + k % 3))
        tail = named[(7 * k + 31) % len(named)] * (k % 2) + "".join(after[(k + 5 * i) % len(after)] for i in range(1 + k % 4))
        pages.append((head + top + opened + "".join(parts) + closed + tail + ("</body></html>" if k % 4 else ""), main))
    return pages


def extract(pages: DataFrame, field: Field | None = None, labelled: list[tuple[str, list[str]]] | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    The blocks that the field takes for main text, in page order, one a line. A null or empty page, and a page without main
    text, has an empty text. Null ids and urls and repeated rows stay as they are, pages are read whole, an empty table
    gives no rows, and other columns are not read.
    """
    field = field or train(labelled or labelled_pages())
    types = {"page_id": pages.schema[id_col].dataType, "url": pages.schema[url_col].dataType}
    schema = T.StructType([T.StructField("page_id", types["page_id"]), T.StructField("url", types["url"]), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    whole = isinstance(types["page_id"], (T.LongType, T.IntegerType))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for page in batch["html"]:
                found = blocks(page) if isinstance(page, str) else []
                texts.append("\n".join(b.text for b, keep in zip(found, field.decode(described(found)), strict=True) if keep))
            ids = batch["page_id"].astype("Int64") if whole else batch["page_id"]
            yield pd.DataFrame({"page_id": ids, "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInPandas(run, schema)

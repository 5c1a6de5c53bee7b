"""Personal data: fixed patterns, and candidates that gradient-boosted trees accept.

Base spans are the matches of one pattern a kind that pass the kind's check. High-recall generators propose further spans:
written-out addresses, numbers without a plus sign or with other separators, and base matches that failed. Boosted trees
score each candidate by its format and its context, and a threshold for each kind, calibrated on predictions for snippets
that the trees had not seen, selects what is added.

The trees are fitted on the driver from a small labelled table of snippets, whose candidates and features come from the
very expressions that run over the documents. Detection is built-in functions only, row by row, without a shuffle. The
patterns are written so that a long run of digits or labels costs linear time and no recursion.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["email", "ip", "card", "phone"]
_SPANS = "array<struct<start:int,kind:int,end:int,body:string>>"

#: Base patterns. Where a match cannot start inside a run, saying so keeps the search linear and changes no match.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}(?:\x20?[\(\[\{]at[\)\]\}]\x20?|\x20at\x20)[A-Za-z0-9-]{2,63}(?:(?:\x20?[\(\[\{]dot[\)\]\}]\x20?|\x20dot\x20)[A-Za-z0-9-]{2,63}){1,4}",
    "ip": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9]{1,3}(?:(?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]{1,3}){3})(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){3}(?![0-9])",
    "phone": r"(?<![0-9.+-])(?:00[0-9]{1,3}[\x20./-])?\(?[0-9]{2,4}\)?[\x20./-]{1,2}(?:[0-9]{2,4}[\x20./-]){1,3}[0-9]{2,4}(?![0-9.-])",
}
_WIDE_HINTS = {"email": r"(?i)[\x20\(\[\{]dot[\x20\)\]\}]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:|[0-9](?:\[\.\]|\(\.\)|\x20\.\x20)[0-9]", "card": r"[0-9]{4}[\x20./_-]{1,2}[0-9]{4}", "phone": r"[0-9][\x20./-]\(?[0-9]{2}"}
_CUES = {
    "email": r"mail|contact|write to|address|reach", "ip": r"\bip\b|host|server|address|addr|login|from", "card": r"card|visa|master|amex|credit|debit|pay",
    "phone": r"tel|phone|call|mobile|fax|ring|cell|dial|whatsapp|sms",
}
_AGAINST = r"isbn|issn|order|invoice|serial|version|\bv\.?$|part|sku|page|section|chapter|item|article|date|year|no\.?$|nr\.?$|id\b"
FEATURES = 9


def _found(text: Column, pattern: str, hint: str) -> tuple[Column, Column]:
    """Matches of a pattern and the texts between them; empty where the hint says that there are none."""
    likely = text.contains("@") if hint == "@" else text.rlike(hint)
    none = F.array().cast("array<string>")
    return F.when(likely, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none), F.when(likely, F.split(text, pattern, -1)).otherwise(none)


def _placed(matches: Column, gaps: Column, kind: int) -> Column:
    """Matches with their places in code points, from the lengths of what lies before them."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x["body"])).alias("end"), x["body"].alias("body"))
        return F.when(x["body"].isNull(), acc).otherwise(F.struct((start + F.length(x["body"])).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans")))

    zipped = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("body")))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")), step)["spans"]


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def _passes(kind: str, body: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(body, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    if kind == "card":
        return F.length(_digits(body)).between(12, 19) & F.call_function("luhn_check", _digits(body))
    if kind == "phone":
        return F.length(_digits(body)).between(9, 15)
    return F.lit(True)


def _side(c: Column) -> Column:
    """Class of a neighbouring character: 0 none or space, 1 mark, 2 letter, 3 digit."""
    return F.when(c.isNull() | (c == "") | c.rlike(r"^\s"), 0).when(c.rlike("^[0-9]"), 3).when(c.rlike(r"^\p{L}"), 2).otherwise(1)


def _features(text: Column, s: Column) -> Column:
    kind, body = s["kind"], s["body"]
    before = F.lower(F.substring(text, F.greatest(s["start"] - 24, F.lit(0)) + 1, F.least(s["start"], F.lit(24))))
    cue = F.lit(False)
    for i, name in enumerate(KINDS):
        cue = F.when(kind == i, before.rlike(_CUES[name])).otherwise(cue)
    marks = F.regexp_replace(body, "[A-Za-z0-9]", "")
    return F.array(
        kind, F.length(_digits(body)), F.call_function("luhn_check", _digits(body)).cast("int"), cue.cast("int"), before.rlike(_AGAINST).cast("int"),
        _side(F.when(s["start"] > 0, F.substring(text, s["start"], F.lit(1)))), _side(F.substring(text, s["end"] + 1, F.lit(1))),
        F.size(F.array_distinct(F.split(marks, ""))), body.rlike(r"[\(\[\{:]").cast("int"),
    )


def candidates(rows: DataFrame) -> DataFrame:
    """``base`` spans and scored-to-be ``wide`` spans with their features, for rows with a column ``text`` without nulls."""
    text = F.col("text")
    cols = {}
    for kind in KINDS:
        cols[f"{kind}_m"], cols[f"{kind}_g"] = _found(text, BASE[kind], _HINTS[kind])
        cols[f"{kind}_wm"], cols[f"{kind}_wg"] = _found(text, WIDE[kind], _WIDE_HINTS[kind])
    rows = rows.withColumns(cols)
    rows = rows.withColumns({f"{kind}_s": _placed(F.col(f"{kind}_m"), F.col(f"{kind}_g"), i) for i, kind in enumerate(KINDS)} | {f"{kind}_w": _placed(F.col(f"{kind}_wm"), F.col(f"{kind}_wg"), i) for i, kind in enumerate(KINDS)})
    rows = rows.withColumn("base", F.array_sort(F.concat(*[_kept(k) for k in KINDS])))
    proposed = F.concat(*[F.col(f"{k}_w") for k in KINDS], *[_failed(k) for k in KINDS])
    apart = F.filter(F.array_distinct(proposed), lambda s: ~F.exists(F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    rows = rows.withColumn("apart", apart)
    wide = F.transform("apart", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), _features(text, s).alias("x")))
    return rows.withColumn("wide", wide).drop("apart", *[f"{k}_{e}" for k in KINDS for e in ("m", "g", "wm", "wg", "s", "w")])


def _kept(kind: str) -> Column:
    return F.filter(F.col(f"{kind}_s"), lambda s: _passes(kind, s["body"]))


def _failed(kind: str) -> Column:
    return F.filter(F.col(f"{kind}_s"), lambda s: ~_passes(kind, s["body"]))


@dataclass
class Trees:
    """Depth-two regression trees over integer features, and a threshold for each kind."""

    start: float
    trees: list[tuple[tuple[int, int], tuple[int, int], tuple[int, int], tuple[float, float, float, float]]]
    thresholds: list[float]

    def margin(self, x: Column) -> Column:
        total = F.lit(self.start)
        for (f, t), (fl, tl), (fr, tr), (a, b, c, d) in self.trees:
            total = total + F.when(x[f] <= t, F.when(x[fl] <= tl, a).otherwise(b)).otherwise(F.when(x[fr] <= tr, c).otherwise(d))
        return total

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for (f, t), (fl, tl), (fr, tr), (a, b, c, d) in self.trees:
            total += np.where(x[:, f] <= t, np.where(x[:, fl] <= tl, a, b), np.where(x[:, fr] <= tr, c, d))
        return total


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, rate: float = 0.3, ridge: float = 1.0) -> Trees:
    """Gradient boosting of the logistic loss by depth-two trees with Newton leaves."""
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    model = Trees(start, [], [0.0] * len(KINDS))
    margin = np.full(len(y), start)

    def best(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple[int, int], float]:
        found, gain = (0, 10**6), -1.0
        for f in range(x.shape[1]):
            for t in np.unique(x[rows, f])[:-1]:
                left = x[rows, f] <= t
                got = g[rows][left].sum() ** 2 / (h[rows][left].sum() + ridge) + g[rows][~left].sum() ** 2 / (h[rows][~left].sum() + ridge)
                if got > gain + 1e-12:
                    found, gain = (f, int(t)), got
        return found, gain

    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        every = np.arange(len(y))
        top, _gain = best(every, g, h)
        left = x[:, top[0]] <= top[1]
        ends, leaves = [], []
        for side in (every[left], every[~left]):
            split, _gain = best(side, g, h) if len(side) else ((0, 10**6), 0.0)
            ends.append(split)
            low = x[side, split[0]] <= split[1]
            leaves += [float(rate * g[s].sum() / (h[s].sum() + ridge)) for s in (side[low], side[~low])]
        tree = (top, ends[0], ends[1], tuple(leaves))
        model.trees.append(tree)
        margin = margin + np.where(left, np.where(x[:, ends[0][0]] <= ends[0][1], leaves[0], leaves[1]), np.where(x[:, ends[1][0]] <= ends[1][1], leaves[2], leaves[3]))
    return model


def labelled_snippets() -> list[tuple[str, int]]:
    """The built-in table: lines whose candidates are all personal data (1) or all not (0)."""
    bodies = {
        "phone": ["555-123-4567", "(212) 555-0182", "0171 555 0182", "212.555.0182", "0049 30 555 0182", "030/555/0182"],
        "card": ["4111.1111.1111.1111", "4111/1111/1111/1111", "4012_8888_8888_1881", "5500.0000.0000.0004", "4111-1111-1111-1112", "4012 8888 8888 1882"],
        "ip": ["10[.]20[.]30[.]40", "192(.)168(.)7(.)9", "172 . 16 . 254 . 1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334"],
        "email": ["jane.roe at mail dot com", "j_roe (at) post (dot) net", "info[at]valley[dot]org", "jan at mail dot example dot com"],
    }
    for_ = {
        "phone": ["call me on {}", "Tel: {}", "phone {} after six", "mobile {}", "Fax {}", "ring {} today", "cell: {}"],
        "card": ["my card {} expires", "visa {}", "credit card number {}", "pay with card {}"],
        "ip": ["the server at {} answered", "login from {}", "ip {}", "host {} is down"],
        "email": ["write to {}", "my mail is {}", "contact {} now", "e-mail: {}", "so {} is where", "{}"],
    }
    against = {
        "phone": ["order {}", "isbn {}", "serial {} of", "invoice no. {}", "part {} is out", "the values {} were seen", "date {}", "x{}", "page {}"],
        "card": ["serial {}", "order {}", "part {} in stock", "isbn {}", "article {}"],
        "ip": ["section {}", "chapter {}", "version {}"],
        "email": [],
    }
    rows = [(line.format(body), 1) for kind, lines in for_.items() for line in lines for body in bodies[kind] if not body.endswith("2") or kind != "card"]
    rows += [(line.format(body), 0) for kind, lines in against.items() for line in lines for body in bodies[kind]]
    rows += [(line.format(body), 0) for line in for_["card"] for body in bodies["card"] if body.endswith("2")]
    rows += [(f"look at {word} dot {other} there", 0) for word, other in (("this", "pattern"), ("the", "matrix"), ("every", "line"))]
    rows += [(line, 0) for line in ("rates of 300.400.500.600 were", "numbers 999.1.1.1 and", "a run of 1234 5678 9012 3456 cases", "code 123456789012345", "+1 2 3", "table 12 34 56 78 90 shows")]
    return rows


def train(spark: SparkSession, snippets: list[tuple[str, int]] | None = None, precision: float = 0.95, folds: int = 5) -> Trees:
    """Fit the trees; each kind's threshold is the lowest that reaches ``precision`` on held-out folds, or beyond every score."""
    listed = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(y).alias("y"), F.lit(i).alias("i")) for i, (t, y) in enumerate(snippets or labelled_snippets())])
    got = candidates(spark.range(1).select(F.inline(listed))).select("i", "y", F.explode("wide").alias("w")).select("i", "y", "w.x").collect()
    x = np.array([r["x"] for r in got]).reshape(len(got), FEATURES)
    y, fold = np.array([r["y"] for r in got], float), np.array([r["i"] for r in got]) % folds
    model = boost(x, y)
    unseen = np.zeros(len(y))
    for k in range(folds):
        unseen[fold == k] = boost(x[fold != k], y[fold != k]).margins(x[fold == k])
    for kind in range(len(KINDS)):
        here = x[:, 0] == kind
        chosen = 50.0
        for at in sorted(set(unseen[here & (unseen > 0)].tolist()), reverse=True):
            picked = here & (unseen >= at)
            if y[picked].mean() >= precision:
                chosen = at
        model.thresholds[kind] = float(chosen)
    return model


def spans(rows: DataFrame, model: Trees | None = None) -> DataFrame:
    """``rows`` (a column ``text`` without nulls and any others) with ``base`` and ``added`` spans, each sorted."""
    model = model or train(rows.sparkSession)
    found = candidates(rows)
    limits = F.array(*[F.lit(t) for t in model.thresholds])
    scored = F.transform("wide", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), (model.margin(s["x"]) - F.element_at(limits, s["kind"] + 1)).alias("over")))
    found = found.withColumn("scored", F.filter(scored, lambda s: s["over"] >= 0)).drop("wide")
    beaten = lambda s: F.exists(F.col("scored"), lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & (F.struct(o["over"], -o["start"], -o["kind"], o["end"]) > F.struct(s["over"], -s["start"], -s["kind"], s["end"])))
    added = F.array_sort(F.transform(F.filter("scored", lambda s: ~beaten(s)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.withColumns({"added": added, "base": base}).drop("scored")


def _written(found: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def detect(docs: DataFrame, model: Trees | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    The counts and the digest are of the base spans, ``spans`` lists base and added ones. A null text counts as empty. Null
    and repeated ids and repeated rows stay as they are, texts are read whole, an empty table gives no rows, and other
    columns are not read. Places are code points, ends exclusive.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = spans(rows, model)
    counts = [F.size(F.filter("base", _of(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def _of(kind: int):
    return lambda s: s["kind"] == kind


def redact(docs: DataFrame, model: Trees | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; overlapping spans become one.

    Null texts stay null, other columns as they are.
    """
    others = [c for c in docs.columns if c != text_col]
    kept = docs.select(F.col(text_col).alias("text"), F.struct(*others).alias("others") if others else F.lit(None).alias("others"))
    found = spans(kept.select(F.coalesce("text", F.lit("")).alias("text"), F.col("text").isNull().alias("missing"), "others"), model)
    names = F.array(*[F.lit(k) for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        piece = F.concat(F.substring(F.col("text"), acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(inside, "").otherwise(F.concat(F.lit("["), F.upper(F.element_at(names, s["kind"] + 1)), F.lit("]"))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    done = F.aggregate(F.array_sort(F.concat("base", "added")), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length(F.col("text")))))
    found = found.withColumn("clean", F.when(~F.col("missing"), done))
    return found.select(*[F.col("clean").alias(c) if c == text_col else F.col(f"others.`{c}`").alias(c) for c in docs.columns])

"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path.

The model is fitted on the driver from a labelled URL table of bounded size, whose n-grams are hashed by the very
expression that scores the pages. Scoring is built-in functions only: the weights are one constant array, and a page's
score is a sum over its own n-grams. There is no shuffle, and only the url and the id reach the scan.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 4096
SIZES = (3, 4)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = [
    Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"),
]

#: Words of the built-in labelled table: hosts made of them are blocked, or allowed.
BLOCKED_WORDS = [
    "casino", "poker", "bets", "betting", "jackpot", "slots", "pills", "pharma", "viagra", "adult", "porn", "xxx", "sex",
    "spam", "ads", "track", "clicks", "popup", "malware", "phish", "warez", "crack", "loans", "payday", "cheap", "replica",
    "lottery", "escort", "hack", "free",
]
ALLOWED_WORDS = [
    "news", "library", "school", "recipes", "garden", "weather", "travel", "science", "history", "museum", "docs", "forum",
    "music", "sport", "health", "city", "books", "maps", "photo", "journal", "radio", "blog", "art", "code", "physics",
    "market", "theatre", "village", "river", "station", "there", "thing", "nation", "mother", "other", "winter", "window",
]


def labelled_urls() -> list[tuple[str, int]]:
    """The built-in table: hosts of one or two words, and allowed hosts of plain syllables.

    Every host appears with the same prefixes, endings and paths, so these tell the classes apart by chance nowhere.
    """
    around = [("", "example.com/en/12"), ("www.", "example.net/de/345.html"), ("m.", "example.org/fr/6789/"), ("blog.", "example.com/es/120"), ("", "example.net/en/7.html"), ("www.", "example.org/de/88/")]
    hosts = []
    for words, label in ((BLOCKED_WORDS, 1), (ALLOWED_WORDS, 0)):
        for i, word in enumerate(words):
            mate = words[(7 * i + 3) % len(words)]
            neutral = ("win", "site", "farm", "shop", "x")[i % 5]
            hosts += [(f"{word}-{mate}", label), (f"{word}-{neutral}", label), (f"{mate}{word}", label)]
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "or", "st", "ti", "ou", "ing", "ion", "ly"]
    hosts += [(parts[i] + parts[(3 * i + k) % 20] + parts[(i + 7 * k + 1) % 20], 0) for i in range(20) for k in range(6)]
    return [(f"https://{before}{host}.{after}", label) for host, label in hosts for before, after in around]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _buckets(where: str, n: int, part: Column) -> Column:
    """Buckets of all n-grams of one part; the characters are laid out once, so time is linear in the url."""

    def of(characters: Column) -> Column:
        last = F.greatest(F.size(characters) - n, F.lit(0))
        hashed = lambda i: F.xxhash64(F.lit(where), F.slice(characters, i + 1, F.lit(n)))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(hashed(i), F.lit(BUCKETS)).cast("int"))

    return F.get(F.transform(F.array(F.split(F.concat(F.lit("^"), part, F.lit("$")), "")), of), 0)


def _grams(host: Column, path: Column) -> Column:
    """Distinct buckets of the n-grams of host and path, each marked with where it stands."""
    return F.array_distinct(F.concat(*[_buckets(where, n, part) for where, part in (("h", host), ("p", path)) for n in SIZES]))


def fit(labelled: DataFrame, max_rows: int = 20_000, steps: int = 400, rate: float = 2.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept from (url, blocked) rows; at most ``max_rows`` of them are used, chosen by hash.

    Rows with a null url or verdict teach nothing, repeated rows count as often as they are there, an empty table gives
    weights of 0, and other columns are not read.
    """
    host, path = host_and_path(F.col("url"))
    rows = labelled.where("url is not null and blocked is not null").select(_grams(host, path).alias("grams"), F.col("blocked").cast("double").alias("y"), F.xxhash64("url").alias("h")).orderBy("h").limit(max_rows).collect()
    weights, bias = np.zeros(BUCKETS), 0.0
    if not rows:
        return weights, bias
    at = np.repeat(np.arange(len(rows)), [len(r["grams"]) for r in rows])
    gram = np.concatenate([r["grams"] for r in rows])
    norm = 1.0 / np.sqrt(np.array([len(r["grams"]) for r in rows], float))
    y = np.array([r["y"] for r in rows])
    for _ in range(steps):
        score = np.bincount(at, weights[gram], len(rows)) * norm + bias
        miss = (y - 1.0 / (1.0 + np.exp(-score))) / len(rows)
        weights += rate * 20 * (np.bincount(gram, (miss * norm)[at], BUCKETS) - decay * weights / 20)
        bias += rate * miss.sum()
    return weights, bias


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, score.

    The longest rule that fits decides; where none fits, the page is blocked if the model's probability reaches
    ``threshold``. A null url or one without ``://`` has an empty host and path, is fitted by no rule, and is judged by the
    model on that. Null ids and repeated rows are kept as they are, an empty table gives no rows, and other columns are not
    read.
    """
    rules = RULES if rules is None else rules
    if labelled is None:
        labelled = _table(pages.sparkSession)
    weights, bias = fit(labelled)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    grams = _grams(F.col("host"), F.col("path"))
    total = F.aggregate(F.col("grams"), F.lit(0.0), lambda acc, g: acc + F.get(F.lit([round(float(w), 6) for w in weights]), g))
    score = 1.0 / (1.0 + F.exp(-(total / F.sqrt(F.size("grams").cast("double")) + bias)))
    by_length = sorted(rules, key=lambda r: (-len(r.text), r.text))
    rule, verdict = F.lit(None).cast("string"), F.when(F.col("score") >= threshold, "block").otherwise("allow")
    for r in reversed(by_length):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rows.withColumn("grams", grams).select("page_id", "host", "path", score.alias("score")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")


def _table(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(u).alias("url"), F.lit(b).alias("blocked")) for u, b in labelled_urls()])
    return spark.range(1).select(F.inline(rows))

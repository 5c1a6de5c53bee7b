"""Fill-in-middle transformation by repeated-capture matching.

One ``fullmatch`` of ``(unit)*`` by the regex library keeps every repetition of its group. The ends of the captures are all
places where a text may be cut: their number is the number of units, and the k-th of them is the cut after k units. Nothing
walks over the units in Python.

The regex library needs about 130 bytes for each repetition and gives up beyond some millions of them, so a text of more
than ``STRETCH`` code points is matched in stretches of ``(unit){0,STRETCH}``, each from where the last one ended. Memory is
bounded by one stretch and one text, and the cuts are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODE_POINT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
STRETCH = 1 << 18

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
])


@lru_cache(16)
def _patterns(unit: str) -> tuple[regex.Pattern, regex.Pattern]:
    return regex.compile(f"({unit})*"), regex.compile(f"({unit}){{0,{STRETCH}}}")


class Cuts:
    """Every place where a text may be cut, by the number of units before it."""

    def __init__(self, text: str, unit: str = CODE_POINT):
        whole, stretch = _patterns(unit)
        if len(text) <= STRETCH:
            found = whole.fullmatch(text)
            if found is None:
                raise ValueError(f"the text is not a sequence of units {unit!r}")
            self.parts = [found.ends(1)]
        else:
            self.parts, at = [], 0
            while at < len(text):
                ends = stretch.match(text, at).ends(1)
                if not ends or ends[-1] == at:
                    raise ValueError(f"the text is not a sequence of units {unit!r}")
                self.parts.append(ends)
                at = ends[-1]

    def __len__(self) -> int:
        return sum(map(len, self.parts))

    def after(self, units: int) -> int:
        """The offset in code points after so many units."""
        for ends in self.parts:
            if units <= len(ends):
                return ends[units - 1] if units else 0
            units -= len(ends)
        raise IndexError("more units than the text has")


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers that depend on the seed and the id alone; a missing id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def transform_text(text: str, h: tuple[int, int, int, int], unit: str, plain_from: int, spm_below: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    cuts = Cuts(text, unit)
    n = len(cuts)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= plain_from:
        return n, PLAIN, None, None, text
    a, b = (cuts.after(k) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_below:
        return n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, unit: str = CODE_POINT, seed: int = 1, plain_from: int = 90, spm_below: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars, output.

    ``unit`` is a pattern whose repetitions tile every text, code points by default. Of the texts, ``plain_from`` in a
    hundred are cut at two places drawn from the seed and the id, ``spm_below`` in a hundred of these put the suffix first;
    the rest, empty texts and texts that hold one of the three marks stay plain, with null lengths. A null text counts as
    empty and a null id as an empty one. Rows with one id share their draws, and repeated rows give repeated rows. An empty
    table gives no rows, and other columns are not read. Whole texts are cut, in a map without a shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64")
            rows = [transform_text(text, draws(None if i is pd.NA else i, seed), unit, plain_from, spm_below) for i, text in zip(ids, batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
            yield out.assign(doc_id=ids.array, prefix_chars=out["prefix_chars"].astype("Int64"), middle_chars=out["middle_chars"].astype("Int64"))[SCHEMA.names]

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInPandas(run, SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text again, from the output and its form alone."""
    parts = F.split(output, "<[PSM]>", -1)
    psm, spm = F.concat(parts[1], parts[3], parts[2]), F.concat(parts[2], parts[3], parts[1])
    return F.when(form == PLAIN, output).when(form == PSM, psm).otherwise(spm)

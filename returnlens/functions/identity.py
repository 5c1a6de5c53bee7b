"""Column functions for tickers, registry numbers, labels and deterministic ids."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of one share class that mean the same listing.
TICKER_ALIASES = {
    "BRK-B": "BRK.B",
    "BRK/B": "BRK.B",
}

EDGE_SPACE = r"^\s+|\s+$"


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value.cast("string"), EDGE_SPACE, "")


def canonical_ticker(value: Column, aliases: dict[str, str] | None = None) -> Column:
    """Upper-cased, trimmed ticker with known alternative spellings folded together."""
    table = TICKER_ALIASES if aliases is None else aliases
    ticker = F.upper(_stripped(F.coalesce(value.cast("string"), F.lit(""))))
    if not table:
        return ticker
    folded = F.create_map(*[F.lit(part) for pair in table.items() for part in pair])
    return F.coalesce(F.try_element_at(folded, ticker), ticker)


def normalize_ticker(value: Column) -> Column:
    return F.upper(_stripped(F.regexp_replace(value.cast("string"), r"\s+", " ")))


def vendor_attempts(ticker: Column, vendor_aliases: Column | None = None) -> Column:
    """Ordered, distinct spellings to try at a vendor: own, listed aliases, then dash and slash forms."""
    own = normalize_ticker(ticker)
    empty = F.array().cast("array<string>")
    listed = empty if vendor_aliases is None else F.coalesce(
        F.transform(vendor_aliases, normalize_ticker), empty
    )
    generated = F.when(
        F.contains(own, F.lit(".")),
        F.array(F.replace(own, F.lit("."), F.lit("-")), F.replace(own, F.lit("."), F.lit("/"))),
    ).otherwise(empty)
    tried = F.concat(F.array(own), listed, generated)
    return F.array_distinct(F.filter(tried, lambda t: t.isNotNull() & (t != "")))


def share_class(ticker: Column) -> Column:
    """Text after the first dot, null when there is none."""
    return F.when(F.contains(ticker, F.lit(".")), F.regexp_extract(ticker, r"^[^.]*\.(.*)$", 1))


def normalize_cik(value: Column) -> Column:
    digits = F.regexp_replace(value.cast("string"), "[^0-9]", "")
    padded = F.lpad(digits, F.greatest(F.lit(10), F.length(digits)), F.lit("0"))
    return F.when(F.length(digits) > 0, padded)


def clean_label(value: Column) -> Column:
    return F.nullif(_stripped(F.regexp_replace(value.cast("string"), r"\s+", " ")), F.lit(""))


def looks_preferred(ticker: Column) -> Column:
    return ticker.rlike(r"[-.]P[A-Z0-9]*$")


def _dashed(digest: Column) -> Column:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(digest, at, size) for at, size in cuts])


def name_uuid(namespace: uuid.UUID, name: Column) -> Column:
    """Version-5 UUID of ``name``, entirely in JVM expressions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    stamped = F.concat(
        F.substring(digest, 1, 12),
        F.lit("5"),
        F.substring(digest, 14, 3),
        variant,
        F.substring(digest, 18, 15),
    )
    return _dashed(stamped)


def md5_uuid(*parts: Column) -> Column:
    """md5 of the colon-joined parts in UUID layout."""
    return _dashed(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])))

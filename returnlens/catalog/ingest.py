"""Queries over identities, feeds, staging, filings, events, exposures and peer selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from returnlens.catalog.core import seen_bars
from returnlens.catalog.panels import CUTOFF, Panels
from returnlens.catalog.registry import STEPS, query
from returnlens.catalog.steps import AT
from returnlens.functions import identity, parsing, scoring
from returnlens.operators import events, exposures, peers, reports, universe
from returnlens.sources import feeds, filings, staging

NS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
LOADED = "2001-05-01 06:00:00"


# ---- identity and parsing functions over the documents and prices tables

STEPS["messy"] = """
SELECT doc_id, concat('  brk', CASE doc_id % 4 WHEN 0 THEN '-b' WHEN 1 THEN '/b' WHEN 2 THEN '.b' ELSE '  x ' END, ' ') AS ticker,
       CASE WHEN doc_id % 5 = 0 THEN 'none' WHEN doc_id % 5 = 1 THEN concat('CIK-', doc_id) WHEN doc_id % 5 = 2 THEN NULL
            ELSE concat('12345678901', doc_id) END AS cik,
       concat('  ', source, '   ', lang, ' ') AS label,
       CASE WHEN doc_id % 3 = 0 THEN '   ' ELSE concat('a  b ', doc_id) END AS blankish
FROM documents"""


def messy(p: Panels):
    n = F.col("doc_id")
    tail = F.when(n % 4 == 0, "-b").when(n % 4 == 1, "/b").when(n % 4 == 2, ".b").otherwise("  x ")
    return p.table("documents").select(
        "doc_id",
        F.concat(F.lit("  brk"), tail, F.lit(" ")).alias("ticker"),
        F.when(n % 5 == 0, "none").when(n % 5 == 1, F.concat(F.lit("CIK-"), n.cast("string")))
        .when(n % 5 > 2, F.concat(F.lit("12345678901"), n.cast("string"))).alias("cik"),
        F.concat(F.lit("  "), "source", F.lit("   "), "lang", F.lit(" ")).alias("label"),
        F.when(n % 3 == 0, "   ").otherwise(F.concat(F.lit("a  b "), n.cast("string"))).alias("blankish"),
    )


@query("canonical_tickers", """
SELECT doc_id, CASE WHEN t IN ('BRK-B', 'BRK/B') THEN 'BRK.B' ELSE t END AS canonical,
       upper(trim(regexp_replace(ticker, '\\s+', ' ', 'g'))) AS normal,
       regexp_matches(t, '[-.]P[A-Z0-9]*$') AS preferred
FROM (SELECT *, upper(trim(ticker)) AS t FROM messy) m""")
def canonical_tickers(p: Panels):
    t = F.col("ticker")
    return messy(p).select(
        "doc_id",
        identity.canonical_ticker(t).alias("canonical"),
        identity.normalize_ticker(t).alias("normal"),
        identity.looks_preferred(F.upper(F.trim(t))).alias("preferred"),
    )


@query("vendor_ticker_attempts", """
SELECT doc_id, CASE WHEN contains(t, '.') THEN concat(t, ',ALT ', doc_id, ',', replace(t, '.', '-'), ',', replace(t, '.', '/'))
                    ELSE concat(t, ',ALT ', doc_id) END AS attempts,
       CASE WHEN contains(t, '.') THEN substr(t, strpos(t, '.') + 1) END AS share_class
FROM (SELECT *, upper(trim(regexp_replace(ticker, '\\s+', ' ', 'g'))) AS t FROM messy) m""")
def vendor_ticker_attempts(p: Panels):
    listed = F.array(F.concat(F.lit(" alt  "), F.col("doc_id").cast("string")), F.col("ticker"))
    return messy(p).select(
        "doc_id",
        F.array_join(identity.vendor_attempts(F.col("ticker"), listed), ",").alias("attempts"),
        identity.share_class(identity.normalize_ticker(F.col("ticker"))).alias("share_class"),
    )


@query("normalized_ciks", """
SELECT doc_id, CASE WHEN length(d) = 0 THEN NULL WHEN length(d) >= 10 THEN d ELSE lpad(d, 10, '0') END AS cik
FROM (SELECT doc_id, regexp_replace(cik, '[^0-9]', '', 'g') AS d FROM messy) m""")
def normalized_ciks(p: Panels):
    return messy(p).select("doc_id", identity.normalize_cik(F.col("cik")).alias("cik"))


@query("clean_labels", """
SELECT doc_id, nullif(trim(regexp_replace(label, '\\s+', ' ', 'g')), '') AS label,
       nullif(trim(regexp_replace(blankish, '\\s+', ' ', 'g')), '') AS blankish FROM messy""")
def clean_labels(p: Panels):
    return messy(p).select(
        "doc_id",
        identity.clean_label(F.col("label")).alias("label"),
        identity.clean_label(F.col("blankish")).alias("blankish"),
    )


@query("name_uuids", f"""
SELECT doc_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-5', substr(h, 14, 3), '-',
         substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1), substr(h, 18, 3), '-', substr(h, 21, 12)) AS id
FROM (SELECT doc_id, sha1(unhex('{NS.hex}') || encode(concat('security:', label))) AS h FROM messy) m""")
def name_uuids(p: Panels):
    return messy(p).select(
        "doc_id", identity.name_uuid(NS, F.concat(F.lit("security:"), F.col("label"))).alias("id")
    )


@query("md5_uuids", """
SELECT doc_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS id
FROM (SELECT doc_id, md5(concat('feed:', doc_id, ':', label)) AS h FROM messy) m""")
def md5_uuids(p: Panels):
    return messy(p).select("doc_id", identity.md5_uuid(F.lit("feed"), F.col("doc_id"), F.col("label")).alias("id"))


@query("parsed_times", """
SELECT event_id, strftime(CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
         WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE date_trunc('day', ts) END, '%Y-%m-%d %H:%M:%S') AS moment,
       CAST(CASE event_id % 4 WHEN 2 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE ts END AS DATE) AS day
FROM events""")
def parsed_times(p: Panels):
    ts, n = F.col("ts"), F.col("event_id") % 4
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    text = (
        F.when(n == 0, F.concat(iso, F.lit("Z"))).when(n == 1, iso).when(n == 2, F.concat(iso, F.lit("+02:00")))
        .otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )
    raw = p.table("events").select("event_id", text.alias("text"))
    return raw.select(
        "event_id",
        F.date_format(parsing.utc_timestamp(F.col("text")), "yyyy-MM-dd HH:mm:ss").alias("moment"),
        parsing.calendar_date(F.col("text")).alias("day"),
    )


@query("json_payloads", """
SELECT id, CASE WHEN isnan(close) THEN NULL ELSE round(close, 2) END AS close, CAST(price_date AS VARCHAR) AS price_date, ticker
FROM price_feed""")
def json_payloads(p: Panels):
    raw = p.price_feed
    text = parsing.json_payload(raw)
    return raw.select("id", text.alias("j")).select(
        "id",
        F.round(F.get_json_object("j", "$.close").cast("double"), 2).alias("close"),
        F.get_json_object("j", "$.price_date").alias("price_date"),
        F.get_json_object("j", "$.ticker").alias("ticker"),
    )


# ---- feeds: payloads written from the panels month by month, parsed back


@query("price_json_feed", f"""
SELECT concat('SEC', security_id) AS ticker, event_date, round(close, 6) AS close,
       round(CASE WHEN security_id % 2 = 0 THEN close * 2 ELSE close END, 6) AS adjusted_close, volume,
       '{LOADED}' AS available FROM price_raw""")
def price_json_feed(p: Panels):
    """One payload per security, source and month."""
    bars = p.price_raw
    even = F.col("security_id") % 2 == 0
    row = F.to_json(
        F.struct(
            F.col("event_date").cast("string").alias("date"),
            "close",
            F.when(even, F.col("close") * 2).alias("adjClose"),
            "volume",
        )
    )
    rows = bars.withColumn("row", row).groupBy("security_id", "source", F.trunc("event_date", "month").alias("month")).agg(
        F.array_join(F.collect_list("row"), ",").alias("rows")
    )
    wrapped = F.when(F.col("security_id") % 3 == 0, F.concat(F.lit('{"historical": ['), "rows", F.lit("]}")))
    payloads = rows.select(
        F.concat(F.lit("sec"), F.col("security_id").cast("string")).alias("ticker"),
        F.coalesce(wrapped, F.concat(F.lit("["), "rows", F.lit("]"))).alias("payload"),
    )
    return feeds.parse_prices(payloads, LOADED).select(
        "ticker",
        "event_date",
        F.round("close", 6).alias("close"),
        F.round("adjusted_close", 6).alias("adjusted_close"),
        "volume",
        F.date_format("timestamp_available", "yyyy-MM-dd HH:mm:ss").alias("available"),
    )


@query("five_factor_csv_feed", """
SELECT series_key AS factor_name, event_date, round(round(value / 100, 4) * 100, 4) AS return_bps
FROM fac WHERE series_key IN ('Mkt-RF', 'SMB', 'HML', 'RMW', 'CMA') AND NOT (series_key = 'SMB' AND day(event_date) = 3)""")
def five_factor_csv_feed(p: Panels):
    """One CSV per month with a preamble before the header and a footer after the data."""
    factors = ["Mkt-RF", "SMB", "HML", "RMW", "CMA"]
    rows = p.factor_return.where(F.col("factor_name").isin(factors) & (F.col("timestamp_available") <= F.lit(CUTOFF).cast("timestamp_ntz")))
    wide = rows.groupBy("event_date").agg(
        *[F.max(F.when(F.col("factor_name") == n, F.round(F.col("return_bps") / 100, 4))).alias(n) for n in factors]
    )
    cell = lambda c: F.when(F.col(f"`{c}`").isNotNull(), F.format_string("%.4f", F.col(f"`{c}`"))).otherwise("")
    smb = F.when(F.dayofmonth("event_date") == 3, F.lit(" -99.99")).otherwise(cell("SMB"))
    line = F.concat_ws(",", F.date_format("event_date", "yyyyMMdd"), F.concat(F.lit("  "), cell("Mkt-RF")), smb, *[cell(c) for c in factors[2:]])
    files = wide.withColumn("line", line).groupBy(F.trunc("event_date", "month").alias("month")).agg(
        F.array_join(F.collect_list("line"), "\n").alias("body")
    )
    payloads = files.select(
        F.concat(F.lit("Daily factors\n,note\n\n,Mkt-RF,SMB,HML,RMW,CMA\n"), "body", F.lit("\nCopyright, 2001\n20000101,1,1,1,1,1\n")).alias("payload")
    )
    parsed = feeds.parse_five_factors(payloads, "1900-01-01", "2100-12-31", LOADED)
    return parsed.select("factor_name", "event_date", F.round("return_bps", 4).alias("return_bps"))


@query("macro_csv_feed", """
SELECT series_name, event_date, value FROM mac WHERE day(event_date) <> 5 AND day(event_date) <> 6 AND series_name <> 'DGS2'
UNION ALL SELECT series_name, CAST(event_date AS DATE), value FROM macro_series WHERE series_name = 'DGS2' AND vintage IS NULL
  AND timestamp_available <= TIMESTAMP '2001-06-01 00:00:00' AND day(event_date) <> 5 AND day(event_date) <> 6""")
def macro_csv_feed(p: Panels):
    """Every series in one of two layouts: the newer one names its value column after the series."""
    seen = p.macro_series.where((F.col("timestamp_available") <= F.lit(CUTOFF).cast("timestamp_ntz")) & F.col("vintage").isNull())
    day = F.dayofmonth("event_date")
    text = F.when(day == 5, ".").when(day == 6, "").otherwise(F.col("value").cast("string"))
    newer = ["DGS10", "DGS2", "T5YIE"]
    when = F.col("event_date").cast("string")
    raw = seen.select(
        "series_name",
        F.when(F.col("series_name").isin(newer), when).alias("observation_date"),
        F.when(~F.col("series_name").isin(newer), when).alias("DATE"),
        *[F.when(F.col("series_name") == n, text).alias(n) for n in newer],
        F.when(~F.col("series_name").isin(newer), text).alias("VALUE"),
    )
    return feeds.parse_macro(raw, "1900-01-01", "2100-12-31", LOADED).select("series_name", "event_date", "value")


@query("submissions_feed", f"""
SELECT lpad(CAST(company_id AS VARCHAR), 10, '0') AS cik, event_type AS form, source_id AS accession_number, CAST(event_time AS DATE) AS filing_date,
       strftime(CASE WHEN event_id % 2 = 0 THEN date_trunc('second', event_time) ELSE date_trunc('day', event_time) END, '%Y-%m-%d %H:%M:%S') AS event_time,
       CASE WHEN event_id % 2 = 0 THEN strftime(date_trunc('second', event_time), '%Y-%m-%d %H:%M:%S') ELSE '{LOADED}' END AS available
FROM event""")
def submissions_feed(p: Panels):
    """Payloads with the parallel lists of the filing index, at most 2,000 filings of one company in each."""
    when = F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    item = F.struct(
        F.col("event_type").alias("form"),
        F.col("source_id").alias("accessionNumber"),
        F.col("event_time").cast("date").cast("string").alias("filingDate"),
        F.when(F.col("event_id") % 2 == 0, when).otherwise("").alias("acceptanceDateTime"),
    )
    lists = p.event.groupBy("company_id", F.floor(F.col("event_id") / 2000).alias("page")).agg(
        F.collect_list(item).alias("items")
    )
    recent = F.struct(*[F.col(f"items.{n}").alias(n) for n in ("form", "accessionNumber", "filingDate", "acceptanceDateTime")])
    payloads = lists.select(
        F.col("company_id").alias("cik"),
        F.to_json(F.struct(F.lit("Co").alias("name"), F.struct(recent.alias("recent")).alias("filings"))).alias("payload"),
    )
    parsed = feeds.parse_submissions(payloads, LOADED)
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return parsed.select(
        "cik",
        "form",
        "accession_number",
        "filing_date",
        text("event_time").alias("event_time"),
        text("timestamp_available").alias("available"),
    )


@query("universe_config", """
SELECT ticker, lpad(cik, 10, '0') AS cik, exchange, CASE WHEN security_id % 4 = 0 THEN 'Unknown' ELSE sector END AS sector,
       CASE WHEN security_id % 3 = 0 THEN 'Unknown' ELSE industry END AS industry,
       CASE WHEN security_id % 3 = 0 THEN 'Unknown' ELSE industry END AS subindustry FROM security""")
def universe_config(p: Panels):
    s, n = p.security, F.col("security_id")
    item = F.struct(
        F.lower("ticker").alias("ticker"),
        F.col("legal_name").alias("name"),
        F.concat(F.lit("CIK"), "cik").alias("cik"),
        "exchange",
        F.when(n % 4 != 0, F.col("sector")).alias("sector"),
        F.when(n % 3 != 0, F.col("industry")).otherwise("  ").alias("industry"),
        F.lit("").alias("subindustry"),
        F.array(F.col("ticker")).alias("vendor_aliases"),
        F.array(F.col("ticker")).alias("peers"),
        F.create_map(F.lit("rates"), F.lit(0.5)).alias("exposures"),
    )
    configs = s.select(F.lit("v0").alias("version"), F.lit("panel").alias("source"), F.lit("1995-01-01").alias("active_from"),
                       F.array(item).alias("securities"))
    return feeds.universe_rows(configs).select("ticker", "cik", "exchange", "sector", "industry", "subindustry")


# ---- staging and promotion


@query("staged_assets", """
SELECT upper(ticker) AS source_ticker, upper(ticker) AS canonical_ticker, company_name_en AS company_name,
       upper(substr(coalesce(currency, 'USD'), 1, 3)) AS currency, is_active FROM asset""")
def staged_assets(p: Panels):
    return staging.stage_assets(p.asset).select("source_ticker", "canonical_ticker", "company_name", "currency", "is_active")


@query("staged_companies", """
SELECT upper(ticker) AS source_ticker, lpad(cik, 10, '0') AS cik, sector, industry FROM security""")
def staged_companies(p: Panels):
    return staging.stage_companies(p.security).select("source_ticker", "cik", "sector", "industry")


@query("staged_prices", """
SELECT id AS source_price_id, upper(ticker) AS source_ticker, price_date, round(close, 2) AS close FROM price_feed
WHERE NOT isnan(close) AND close > 0""")
def staged_prices(p: Panels):
    good, _ = staging.stage_prices(p.price_feed)
    return good.select("source_price_id", "source_ticker", "price_date", F.round("close", 2).alias("close"))


@query("rejected_prices", """
SELECT 'price_rejected' AS issue_type, CAST(id AS VARCHAR) AS source_key,
       concat('non-positive close for source price ', id) AS details FROM price_feed WHERE isnan(close) OR close <= 0""")
def rejected_prices(p: Panels):
    _, refused = staging.stage_prices(p.price_feed)
    return refused.select("issue_type", "source_key", "details")


@query("staged_source_rows", """
SELECT event_id AS source_id, concat('T', user_id % 25) AS canonical_ticker, CAST(ts AS DATE) AS as_of_date, event_type AS theme_key
FROM events""")
def staged_source_rows(p: Panels):
    raw = p.table("events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), (F.col("user_id") % 25).cast("string")).alias("ticker"),
        F.col("ts").alias("as_of_date"),
        F.col("event_type").alias("theme_key"),
        "value",
    )
    staged = staging.stage_rows(raw, "theme_score", "as_of_date", ["theme_key"])
    return staged.select("source_id", "canonical_ticker", "as_of_date", "theme_key")


@query("corrected_currencies", """
SELECT upper(substr(coalesce(a.currency, 'USD'), 1, 3)) AS currency, count(*) AS prices FROM price_feed p JOIN asset a ON a.ticker = p.ticker
WHERE NOT isnan(p.close) AND p.close > 0 GROUP BY 1""")
def corrected_currencies(p: Panels):
    good, _ = staging.stage_prices(p.price_feed)
    fixed = staging.correct_currency(good, staging.stage_assets(p.asset))
    return fixed.groupBy("currency").agg(F.count("*").alias("prices"))


@query("promoted_prices", """
SELECT security_id, event_date, round(close, 2) AS close, volume,
       concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS price_bar_id
FROM (SELECT h.security_id, p.price_date AS event_date, p.close, p.volume, md5(concat('feed:', h.security_id, ':', p.price_date)) AS h,
        row_number() OVER (PARTITION BY h.security_id, p.price_date ORDER BY p.id DESC) AS rn
      FROM price_feed p JOIN (SELECT ticker, security_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker
             ORDER BY active_from DESC, security_id) AS rn FROM ticker_history WHERE active_to IS NULL) t WHERE rn = 1) h
        ON h.ticker = upper(p.ticker)
      WHERE NOT isnan(p.close) AND p.close >= 0.000001 AND p.close < 1000000000000) x WHERE rn = 1""")
def promoted_prices(p: Panels):
    good, _ = staging.stage_prices(p.price_feed)
    bars = staging.promote_prices(good, p.ticker_history, "feed", LOADED)
    return bars.select("security_id", "event_date", F.round("close", 2).alias("close"), "volume", "price_bar_id")


@query("source_inventory", """
SELECT 'prices' AS source_table, count(*) AS rows, min(price_date) AS min_date, max(price_date) AS max_date,
       count(DISTINCT ticker) AS tickers FROM price_feed
UNION ALL SELECT 'assets', count(*), NULL, NULL, NULL FROM asset""")
def source_inventory(p: Panels):
    return staging.source_inventory({"prices": (p.price_feed, "price_date"), "assets": (p.asset, None)})


@query("first_price_dates", "SELECT upper(ticker) AS canonical_ticker, min(price_date) AS first_price_date FROM price_feed WHERE NOT isnan(close) AND close > 0 GROUP BY 1")
def first_price_dates(p: Panels):
    return staging.first_price_dates(staging.stage_prices(p.price_feed)[0])


@query("promoted_identities", """
SELECT 'company' AS kind, s.ticker, CAST(NULL AS VARCHAR) AS active_from FROM security s WHERE s.security_id % 2 = 1
UNION ALL
SELECT 'security', s.ticker, strftime(min(p.price_date), '%Y-%m-%d') FROM security s LEFT JOIN price_feed p ON upper(p.ticker) = s.ticker
  AND NOT isnan(p.close) AND p.close > 0
WHERE s.ticker NOT IN (SELECT ticker FROM ticker_history WHERE active_to IS NULL AND security_id % 4 = 0) GROUP BY s.ticker""")
def promoted_identities(p: Panels):
    companies = p.security.where("security_id % 2 = 0").select("company_id", "cik", "legal_name")
    history = p.ticker_history.where("security_id % 4 = 0")
    made, fresh = staging.promote_identities(
        staging.stage_assets(p.asset),
        staging.stage_companies(p.security),
        staging.stage_prices(p.price_feed)[0],
        companies,
        history,
        LOADED,
    )
    named = made.join(p.security.select("cik", "ticker"), "cik")
    return named.select(
        F.lit("company").alias("kind"), "ticker", F.lit(None).cast("string").alias("active_from")
    ).unionByName(
        fresh.select(F.lit("security").alias("kind"), "ticker", F.date_format("active_from", "yyyy-MM-dd").alias("active_from"))
    )


@query("feed_identities", """
SELECT s.cik, CASE WHEN s.security_id % 3 = 0 THEN 'cik' WHEN h.ticker IS NOT NULL THEN 'ticker' ELSE 'new' END AS matched_by,
       concat('Renamed ', s.ticker) AS legal_name
FROM security s LEFT JOIN (SELECT t.ticker FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY active_from DESC, security_id) AS rn
    FROM ticker_history WHERE active_to IS NULL AND security_id % 2 = 0) t WHERE rn = 1) h ON h.ticker = s.ticker""")
def feed_identities(p: Panels):
    n = F.col("company_id")
    companies = p.security.select("company_id", F.when(n % 3 == 0, F.col("cik")).alias("cik"), "legal_name")
    feed = p.security.select("cik", "ticker", F.concat(F.lit("Renamed "), "ticker").alias("company_name"))
    found = staging.ensure_identities(feed, companies, p.security, p.ticker_history.where("security_id % 2 = 0"))
    return found.select("cik", "matched_by", "legal_name")


# ---- filing corpus

STEPS["corpus"] = """
SELECT concat('path/', doc_id) AS path, doc_id, file_ticker, accession, source AS title, filing_date, text,
       CASE WHEN doc_id % 17 = 3 THEN 'nothing' ELSE accession END AS payload_accession,
       CASE WHEN doc_id % 19 = 4 THEN 'OTHER' ELSE file_ticker END AS payload_ticker FROM filings"""

STEPS["clean_corpus"] = r"""
SELECT *, regexp_replace(replace(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(0), ''), '^\s+|\s+$', '', 'g') AS cleaned FROM corpus"""

STEPS["checked"] = r"""
SELECT path, file_ticker AS source_ticker, accession AS accession_number, upper(title) AS form_type, sha256(cleaned) AS text_sha256,
       length(cleaned) AS text_length,
       CASE WHEN payload_accession <> accession THEN 'accession does not match doc_id'
            WHEN payload_ticker <> file_ticker THEN 'ticker does not match payload'
            WHEN text IS NULL OR NOT regexp_matches(text, '\S') THEN 'missing filing text' END AS rejection_reason
FROM clean_corpus"""

STEPS["chosen_filings"] = """
SELECT c.accession_number, t.chosen, c.path, c.text_length FROM (
  SELECT c.*, row_number() OVER (PARTITION BY c.accession_number ORDER BY c.source_ticker <> t.chosen, c.text_length DESC, c.path) AS rn
  FROM checked c JOIN (SELECT accession_number, source_ticker AS chosen FROM (
      SELECT accession_number, source_ticker, row_number() OVER (PARTITION BY accession_number
        ORDER BY regexp_matches(source_ticker, '[-.]P[A-Z0-9]*$'), length(source_ticker), source_ticker) AS rn
      FROM (SELECT DISTINCT accession_number, source_ticker FROM checked WHERE rejection_reason IS NULL) d) r WHERE rn = 1) t
    ON t.accession_number = c.accession_number WHERE c.rejection_reason IS NULL) c
JOIN (SELECT accession_number, source_ticker AS chosen FROM (
      SELECT accession_number, source_ticker, row_number() OVER (PARTITION BY accession_number
        ORDER BY regexp_matches(source_ticker, '[-.]P[A-Z0-9]*$'), length(source_ticker), source_ticker) AS rn
      FROM (SELECT DISTINCT accession_number, source_ticker FROM checked WHERE rejection_reason IS NULL) d) r WHERE rn = 1) t
  ON t.accession_number = c.accession_number WHERE c.rn = 1"""


def checked(p: Panels):
    n, acc, ticker = F.col("doc_id"), F.col("accession"), F.col("file_ticker")
    raw = p.filings.select(
        F.concat(F.lit("path/"), n.cast("string")).alias("path"),
        F.concat(ticker, F.lit("-"), acc, F.lit(".jsonl")).alias("file_name"),
        F.when(n % 17 == 3, "nothing").otherwise(acc).alias("doc_id"),
        F.when(n % 19 == 4, "other").otherwise(F.lower(ticker)).alias("ticker"),
        F.col("source").alias("title"),
        F.lit(None).cast("string").alias("source_type"),
        F.col("filing_date").cast("string").alias("date"),
        F.lit("2000-01-03T10:00:00Z").alias("available_at"),
        F.lit(None).cast("string").alias("published_at"),
        F.lit(None).cast("string").alias("ingested_at"),
        F.lit(None).cast("string").alias("source_url"),
        F.lit(None).cast("string").alias("content_hash"),
        "text",
    )
    return filings.check_filings(raw)


@query("filing_checks", """
SELECT path, source_ticker, accession_number, form_type, text_length, text_sha256, rejection_reason FROM checked""")
def filing_checks(p: Panels):
    return checked(p).select(
        "path", "source_ticker", "accession_number", "form_type", "text_length", "text_sha256", "rejection_reason"
    )


@query("filing_scan_report", """
SELECT 'files_seen' AS metric, count(*) AS value FROM checked
UNION ALL SELECT 'rejected_records', count(rejection_reason) FROM checked
UNION ALL SELECT 'valid_records', count(*) FROM checked WHERE rejection_reason IS NULL
UNION ALL SELECT 'unique_accessions', count(DISTINCT accession_number) FROM checked WHERE rejection_reason IS NULL
UNION ALL SELECT 'duplicate_accessions', count(*) FROM (SELECT 1 FROM checked WHERE rejection_reason IS NULL GROUP BY accession_number HAVING count(*) > 1) a
UNION ALL SELECT 'duplicate_hashes', count(*) FROM (SELECT 1 FROM checked WHERE rejection_reason IS NULL GROUP BY text_sha256 HAVING count(*) > 1) b
UNION ALL SELECT 'source_tickers', count(DISTINCT source_ticker) FROM checked WHERE rejection_reason IS NULL
UNION ALL SELECT concat('form:', form_type), count(*) FROM checked WHERE rejection_reason IS NULL GROUP BY 1""")
def filing_scan_report(p: Panels):
    return filings.scan_report(checked(p))


@query("filing_choice", "SELECT accession_number, chosen AS canonical_ticker, path, text_length FROM chosen_filings")
def filing_choice(p: Panels):
    return filings.choose_filings(filings.valid(checked(p))).select(
        "accession_number", "canonical_ticker", "path", "text_length"
    )


@query("filing_aliases", """
SELECT DISTINCT accession_number, source_ticker FROM checked WHERE rejection_reason IS NULL""")
def filing_aliases(p: Panels):
    return filings.accession_aliases(filings.valid(checked(p)))


@query("filing_issues", """
SELECT 'error' AS severity, 'filing_rejected' AS issue_type, path AS source_key FROM checked WHERE rejection_reason IS NOT NULL
UNION ALL
SELECT 'warning', 'duplicate_accession_mixed_hash', accession_number FROM checked WHERE rejection_reason IS NULL
GROUP BY accession_number HAVING count(*) > 1 AND count(DISTINCT text_sha256) > 1""")
def filing_issues(p: Panels):
    seen = checked(p)
    both = filings.rejection_issues(seen).unionByName(filings.mixed_hash_issues(filings.valid(seen)))
    return both.select("severity", "issue_type", "source_key")


@query("filing_events", """
SELECT f.accession_number AS source_id, h.security_id, strftime(TIMESTAMP '2000-01-03 10:00:00', '%Y-%m-%d %H:%M:%S') AS event_time,
       concat(substr(m, 1, 8), '-', substr(m, 9, 4), '-', substr(m, 13, 4), '-', substr(m, 17, 4), '-', substr(m, 21, 12)) AS event_id
FROM (SELECT *, md5(concat('filings:', accession_number)) AS m FROM chosen_filings) f
JOIN (SELECT ticker, security_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY active_from DESC, security_id) AS rn
      FROM ticker_history WHERE active_to IS NULL) t WHERE rn = 1) h ON h.ticker = f.chosen
JOIN security s ON s.security_id = h.security_id""")
def filing_events(p: Panels):
    good = filings.valid(checked(p))
    made = filings.promote_filings(
        filings.choose_filings(good), filings.accession_aliases(good), p.security, p.ticker_history, "filings"
    )
    return made.select(
        "source_id", "security_id", F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "event_id"
    )


# ---- events and exposures


@query("event_taxonomy", """
SELECT e.event_id, e.code AS eight_k_item_code,
       CASE WHEN e.event_type = '8-K' AND i.c IS NOT NULL THEN i.c ELSE f.c END AS event_category,
       CASE WHEN e.event_type = '8-K' AND i.c IS NOT NULL THEN i.d ELSE 'mixed' END AS event_direction,
       CASE WHEN e.event_type = '8-K' AND i.c IS NOT NULL THEN i.m ELSE f.m END AS materiality
FROM (SELECT *, trim(coalesce(structured_payload ->> '$.item', structured_payload ->> '$.item_code',
        structured_payload ->> '$.eight_k_item', structured_payload ->> '$."8k_item"')) AS code FROM event) e
LEFT JOIN (VALUES ('8-K', 'corporate_event', 0.70::DOUBLE), ('10-K', 'periodic_results', 0.65), ('10-Q', 'periodic_results', 0.55),
  ('13G', 'ownership', 0.50), ('4', 'insider_activity', 0.35)) f(form, c, m) ON f.form = e.event_type
LEFT JOIN (VALUES ('2.02', 'earnings', 'mixed', 0.90::DOUBLE), ('2.06', 'accounting', 'negative', 0.85), ('5.02', 'management', 'mixed', 0.65),
  ('7.01', 'disclosure', 'mixed', 0.50), ('9.01', 'disclosure', 'mixed', 0.35)) i(code, c, d, m) ON i.code = e.code""")
def event_taxonomy(p: Panels):
    return events.classify(p.event).select(
        "event_id", "eight_k_item_code", "event_category", "event_direction", "materiality"
    )


STEPS["features"] = """
SELECT e.event_id, e.company_id, e.event_type, e.timestamp_available, s.r AS relevance, s.n AS novelty, s.m AS magnitude, s.x AS exposure_match,
       CASE WHEN e.source = 'sec_edgar' THEN 1.0 ELSE 0.7 END AS source_credibility,
       concat('source=', e.source, '; form=', e.event_type, '; accession=', e.source_id) AS evidence_span
FROM event e JOIN (VALUES ('8-K', 0.95::DOUBLE, 0.75::DOUBLE, 0.70::DOUBLE, 0.70::DOUBLE), ('10-K', 0.90, 0.55, 0.65, 0.60),
  ('10-Q', 0.85, 0.45, 0.55, 0.55), ('13G', 0.80, 0.70, 0.50, 0.65), ('4', 0.65, 0.35, 0.25, 0.35)) s(form, r, n, m, x) ON s.form = e.event_type"""


@query("event_features", """
SELECT event_id, company_id, relevance, novelty, magnitude, exposure_match, CAST(source_credibility AS DOUBLE) AS source_credibility,
       evidence_span FROM features""")
def event_features(p: Panels):
    return events.event_features(p.event).select(
        "event_id", "company_id", "relevance", "novelty", "magnitude", "exposure_match", "source_credibility", "evidence_span"
    )


@query("event_surprises", """
SELECT event_id, round(v, 8) AS surprise_value, CASE WHEN v > 0.01 THEN 'positive' WHEN v < -0.01 THEN 'negative' ELSE 'neutral' END AS direction
FROM (SELECT e.event_id, (e.value - m.expected) / coalesce(CASE WHEN e.event_id % 2 = 0 THEN 40.0 END, greatest(abs(m.expected), 1e-9)) AS v
      FROM event e JOIN (SELECT event_type, round(avg(value), 4) AS expected FROM event GROUP BY 1) m ON m.event_type = e.event_type) x""")
def event_surprises(p: Panels):
    mean = p.event.groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("expected_value"))
    figures = p.event.join(mean, "event_type").select(
        "event_id",
        F.col("value").alias("actual_value"),
        "expected_value",
        F.when(F.col("event_id") % 2 == 0, 40.0).alias("scale"),
    )
    return events.event_surprises(figures).select(
        "event_id", F.round("surprise_value", 8).alias("surprise_value"), "direction"
    )


STEPS["exposure_votes"] = """
SELECT company_id, CASE event_type WHEN '8-K' THEN 'corporate_event_disclosure' WHEN '13G' THEN 'ownership_structure'
         WHEN '4' THEN 'insider_activity' ELSE 'periodic_financial_reporting' END AS exposure_name, event_id, timestamp_available,
       relevance >= 0.80 AND magnitude >= 0.50 AND novelty >= 0.45 AS review, relevance >= 0.90 AND magnitude >= 0.65 AS high
FROM features WHERE timestamp_available >= TIMESTAMP '2000-01-20 00:00:00' - INTERVAL 5 DAY
  AND timestamp_available <= TIMESTAMP '2000-01-20 00:00:00'"""


def recent(p: Panels):
    return exposures.recent_features(events.event_features(p.event), p.event, "2000-01-20 00:00:00", 5)


@query("exposure_decisions", """
SELECT company_id, exposure_name, CASE WHEN r THEN 'candidate_review' ELSE 'no_update' END AS decision, r AS review_required,
       CASE WHEN r THEN 'Medium' ELSE 'Medium-High' END AS confidence,
       CASE WHEN r THEN concat(reviews, ' material structured event feature(s) for ', exposure_name,
              '; MVP policy requires human review before structural exposure changes.')
            ELSE concat(n, ' event feature(s) for ', exposure_name,
              ', but evidence is not persistent or material enough for an exposure update.') END AS rationale
FROM (SELECT company_id, exposure_name, count(*) AS n, count(*) FILTER (WHERE review) AS reviews,
        count(*) FILTER (WHERE review) >= 2 OR count(*) FILTER (WHERE high) > 0 AS r FROM exposure_votes GROUP BY 1, 2) v""")
def exposure_decisions(p: Panels):
    return exposures.exposure_decisions(recent(p), "2000-01-20 00:00:00").select(
        "company_id", "exposure_name", "decision", "review_required", "confidence", "rationale"
    )


@query("exposure_decision_evidence", """
SELECT company_id, exposure_name, event_id FROM (
  SELECT *, count(*) FILTER (WHERE review) OVER (PARTITION BY company_id, exposure_name) AS reviews,
         row_number() OVER (PARTITION BY company_id, exposure_name ORDER BY timestamp_available, event_id) AS rn FROM exposure_votes) v
WHERE review OR (reviews = 0 AND rn <= 3)""")
def exposure_decision_evidence(p: Panels):
    rows = recent(p)
    return exposures.decision_evidence(rows, exposures.exposure_decisions(rows, "2000-01-20 00:00:00"))


@query("recent_exposure_decisions", """
SELECT DISTINCT company_id, exposure_name FROM exposure_votes WHERE company_id = 4 ORDER BY 2 LIMIT 25""")
def recent_exposure_decisions(p: Panels):
    from returnlens.operators.pit import active_ticker_map

    made = exposures.exposure_decisions(recent(p), "2000-01-20 00:00:00")
    return exposures.recent_decisions(made, p.security, active_ticker_map(p.ticker_history), "nation_4").select(
        "company_id", "exposure_name"
    )


@query("exposure_gates", """
SELECT c_custkey, round(least(1.0, abs(net) / 0.2), 9) AS commodity, CASE WHEN net > 0 THEN 'positive' WHEN net < 0 THEN 'negative' ELSE 'unknown' END AS commodity_sign,
       CASE WHEN net > 0 THEN 'negative' WHEN net < 0 THEN 'positive' ELSE 'unknown' END AS fx_sign,
       round(least(1.0, abs((a + b + 0.1 + 0.2) / 4)), 9) AS rate, round(1 / (1 + exp(-((a - b + 0.1 - 0.2) / 4))), 9) AS credit,
       CASE WHEN a <= 0 THEN 'none' WHEN a < 0.35 THEN 'low' WHEN a < 0.65 THEN 'medium' WHEN a < 0.90 THEN 'high' ELSE 'critical' END AS bucket,
       CASE WHEN a <= 0 THEN 0.0 WHEN a < 0.35 THEN 0.25 WHEN a < 0.65 THEN 0.5 WHEN a < 0.90 THEN 0.75 ELSE 1.0 END::DOUBLE AS bucket_gate
FROM (SELECT c_custkey, c_acctbal / 10000 AS a, (c_custkey % 10) / 10.0::DOUBLE AS b,
        (c_acctbal / 10000 - (c_custkey % 10) / 10.0::DOUBLE) * (1 - 0.25::DOUBLE) AS net FROM customer) x""")
def exposure_gates(p: Panels):
    rows = p.table("customer").select(
        "c_custkey", (F.col("c_acctbal") / 10000).alias("a"), ((F.col("c_custkey") % 10) / 10.0).alias("b")
    )
    a, b, hedge = F.col("a"), F.col("b"), F.lit(0.25)
    return rows.select(
        "c_custkey",
        scoring.commodity_gate(a, b, hedge).alias("commodity"),
        scoring.fx_gate(a, b, hedge).alias("fx"),
        scoring.rate_gate(a, b, F.lit(0.1), F.lit(0.2)).alias("rate"),
        scoring.credit_gate(a, b, F.lit(0.1), F.lit(0.2)).alias("credit"),
        scoring.exposure_bucket(a).alias("bucket"),
    ).select(
        "c_custkey",
        F.round("commodity.gate_weight", 9).alias("commodity"),
        F.col("commodity.expected_sign").alias("commodity_sign"),
        F.col("fx.expected_sign").alias("fx_sign"),
        F.round("rate.gate_weight", 9).alias("rate"),
        F.round("credit.gate_weight", 9).alias("credit"),
        "bucket",
        scoring.bucket_gate(F.col("bucket")).alias("bucket_gate"),
    )


@query("short_interest_signals", """
SELECT p_partkey, CASE WHEN p_size > 10 THEN round(p_retailprice / (p_size - 10), 6) END AS days_to_cover,
       round(p_retailprice / CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey + 1 END, 6) AS share_of_float,
       CASE WHEN p_partkey % 3 = 0 THEN 'Medium' ELSE 'Medium-High' END AS confidence FROM part""")
def short_interest_signals(p: Panels):
    floating = F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") + 1)
    return p.table("part").select(
        "p_partkey",
        F.round(scoring.days_to_cover(F.col("p_retailprice"), F.col("p_size") - 10), 6).alias("days_to_cover"),
        F.round(scoring.short_interest_share(F.col("p_retailprice"), floating), 6).alias("share_of_float"),
        scoring.short_interest_confidence(floating).alias("confidence"),
    )


@query("confidence_ladder", """
SELECT event_id, ['High', 'Medium-High', 'Medium', 'Low-Medium', 'Low'][least(5, 1 + steps)] AS confidence
FROM (SELECT event_id, CASE WHEN user_id < 20 THEN 2 ELSE 0 END + CASE WHEN value > 30 THEN 1 ELSE 0 END
        + CASE WHEN event_type = 'click' THEN 1 ELSE 0 END + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS steps FROM events) e""")
def confidence_ladder(p: Panels):
    steps = scoring.factor_penalty(
        F.col("user_id"), 20, F.col("value"), F.col("event_type") == "click", F.col("event_id") % 2 == 0
    )
    return p.table("events").select("event_id", scoring.confidence_after(steps).alias("confidence"))


STEPS["labelled"] = """
SELECT s_suppkey AS company_id, CASE s_suppkey % 6 WHEN 0 THEN 'Financials' WHEN 1 THEN 'Energy' WHEN 2 THEN 'Information Technology'
         WHEN 3 THEN 'Health Care' WHEN 4 THEN 'Consumer Discretionary' ELSE 'Industrials' END AS sector,
       CASE s_suppkey % 4 WHEN 0 THEN 'Banks' WHEN 1 THEN 'Oil Services' WHEN 2 THEN 'Software' ELSE 'Retail' END AS industry, s_name AS ticker
FROM supplier"""


def labelled(p: Panels):
    n = F.col("s_suppkey")
    sectors = ["Financials", "Energy", "Information Technology", "Health Care", "Consumer Discretionary", "Industrials"]
    industries = ["Banks", "Oil Services", "Software", "Retail"]
    return p.table("supplier").select(
        n.alias("company_id"),
        F.get(F.array(*[F.lit(s) for s in sectors]), (n % 6).cast("int")).alias("sector"),
        F.get(F.array(*[F.lit(s) for s in industries]), (n % 4).cast("int")).alias("industry"),
        F.col("s_name").alias("ticker"),
        F.lit("1995-01-01").cast("date").alias("first_price_date"),
    )


@query("sector_macro_exposures", """
SELECT company_id, unnest(['rates', 'credit', 'inflation']) AS exposure_name, round(CAST(unnest([rates, credit, inflation]) AS DOUBLE), 4) AS exposure_value
FROM (SELECT company_id, CASE WHEN h THEN least(r2, 0.55) ELSE r2 END AS rates,
        CASE WHEN h THEN least(c4, 0.55) ELSE c4 END AS credit, CASE WHEN e THEN 0.85 ELSE 0.50 END AS inflation
      FROM (SELECT *, CASE WHEN t THEN least(c3, 0.55) ELSE c3 END AS c4 FROM (
        SELECT *, CASE WHEN e THEN greatest(c2, 0.75) ELSE c2 END AS c3 FROM (
        SELECT *, CASE WHEN d THEN greatest(r1, 0.80) ELSE r1 END AS r2, CASE WHEN d THEN greatest(c1, 0.75) ELSE c1 END AS c2 FROM (
        SELECT *, CASE WHEN f THEN 0.90 ELSE 0.65 END AS r1, CASE WHEN f THEN 0.85 ELSE 0.65 END AS c1 FROM (
        SELECT company_id, regexp_matches(x, 'financial|bank|mortgage|insurance|real estate|utility') AS f,
          regexp_matches(x, 'consumer discretionary|retail|auto|airline|hotel') AS d,
          regexp_matches(x, 'energy|oil|gas|materials|metals|chemical') AS e,
          regexp_matches(x, 'technology|software|semiconductor|communication') AS t,
          regexp_matches(x, 'health care|pharmaceutical|biotechnology') AS h
        FROM (SELECT *, lower(concat(sector, ' ', industry)) AS x FROM labelled) l) a) b) c) d) e) z""")
def sector_macro_exposures(p: Panels):
    return exposures.sector_macro_exposures(labelled(p)).select(
        "company_id", "exposure_name", F.round("exposure_value", 4).alias("exposure_value")
    )


@query("heuristic_exposures", """
SELECT company_id, n AS exposure_name, round(v, 4) AS exposure_value,
       CASE WHEN v < 0.35 THEN 'low' WHEN v < 0.65 THEN 'medium' WHEN v < 0.90 THEN 'high' ELSE 'critical' END AS exposure_bucket
FROM (SELECT company_id, unnest(['rates', 'credit', 'inflation', 'wti', 'natural_gas']) AS n,
        CAST(unnest([CASE WHEN industry = 'Banks' THEN 0.9 WHEN sector = 'Financials' THEN 0.85 ELSE 0.5 END,
                CASE WHEN industry = 'Banks' THEN 0.9 WHEN sector = 'Energy' THEN 0.5 WHEN sector = 'Financials' THEN 0.75 ELSE 0.35 END,
                CASE WHEN sector = 'Consumer Discretionary' THEN 0.65 ELSE 0.35 END,
                CASE WHEN sector = 'Energy' THEN 0.9 END, CASE WHEN sector = 'Energy' THEN 0.6 END]) AS DOUBLE) AS v FROM labelled) x WHERE v IS NOT NULL""")
def heuristic_exposures(p: Panels):
    return exposures.heuristic_exposures(labelled(p), "mapping-v0", "exposure-v0").select(
        "company_id", "exposure_name", F.round("exposure_value", 4).alias("exposure_value"), "exposure_bucket"
    )


# ---- peers and universe

STEPS["liquid_pairs"] = """
SELECT t.security_id AS target_security_id, p.security_id AS peer_security_id,
       row_number() OVER (PARTITION BY t.security_id ORDER BY p.price_bar_count DESC, p.ticker) AS rn
FROM (SELECT *, count(*) OVER (PARTITION BY industry) - 1 >= 3 AS by_industry FROM supplier_candidates) t
JOIN supplier_candidates p ON p.security_id <> t.security_id
 AND ((t.by_industry AND p.industry = t.industry) OR (NOT t.by_industry AND p.sector = t.sector))"""


@query("liquid_peers", """
SELECT target_security_id, peer_security_id, round(1.0 / count(*) OVER (PARTITION BY target_security_id), 6) AS weight
FROM (SELECT * FROM liquid_pairs WHERE rn <= 20) r QUALIFY count(*) OVER (PARTITION BY target_security_id) >= 3""")
def liquid_peers(p: Panels):
    return peers.liquid_peers(p.supplier_candidates).select(
        "target_security_id", "peer_security_id", F.round("weight", 6).alias("weight")
    )


@query("close_peers", """
SELECT target_security_id, peer_security_id, round(1.0 / count(*) OVER (PARTITION BY target_security_id), 6) AS weight
FROM (SELECT t.security_id AS target_security_id, p.security_id AS peer_security_id, row_number() OVER (PARTITION BY t.security_id
        ORDER BY CASE WHEN p.subindustry = t.subindustry THEN 0 ELSE 1 END, p.ticker) AS rn
      FROM supplier_candidates t JOIN supplier_candidates p ON p.ticker <> t.ticker
       AND (p.subindustry = t.subindustry OR p.sector = t.sector)) r
WHERE rn <= 20 QUALIFY count(*) OVER (PARTITION BY target_security_id) >= 3""")
def close_peers(p: Panels):
    return peers.close_peers(p.supplier_candidates).select(
        "target_security_id", "peer_security_id", F.round("weight", 6).alias("weight")
    )


@query("listed_peers", """
SELECT s.security_id AS target_security_id, h.security_id AS peer_security_id, round(1.0 / count(*) OVER (PARTITION BY s.security_id), 6) AS weight
FROM security s JOIN (SELECT ticker, security_id FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY active_from DESC, security_id) AS rn
      FROM ticker_history WHERE active_to IS NULL) t WHERE rn = 1) h
  ON h.ticker IN (concat('NATION_', (s.security_id + 1) % 25), concat('NATION_', (s.security_id + 2) % 25))""")
def listed_peers(p: Panels):
    from returnlens.operators.pit import active_ticker_map

    n = F.col("security_id")
    name = lambda k: F.concat(F.lit("NATION_"), ((n + k) % 25).cast("string"))
    lists = p.security.select("security_id", "ticker", F.array(name(1), name(2), name(0), F.lit("GHOST")).alias("peers"))
    return peers.listed_peers(lists, active_ticker_map(p.ticker_history)).select(
        "target_security_id", "peer_security_id", F.round("weight", 6).alias("weight")
    )


@query("price_coverage", "SELECT security_id, first_price_date, last_price_date, price_bar_count FROM coverage")
def price_coverage(p: Panels):
    return universe.price_coverage(seen_bars(p))


@query("eligible_universe", """
SELECT a.ticker, h.security_id, c.price_bar_count FROM (SELECT *, upper(ticker) AS t FROM asset) a
JOIN ticker_history h ON h.ticker = a.t AND h.active_to IS NULL JOIN coverage c ON c.security_id = h.security_id
WHERE lower(a.asset_type) = 'stock' AND upper(substr(coalesce(a.currency, 'USD'), 1, 3)) = 'USD' AND a.is_active AND c.price_bar_count >= 100""")
def eligible_universe(p: Panels):
    found = universe.eligible_members(
        staging.stage_assets(p.asset), p.ticker_history, universe.price_coverage(seen_bars(p)), 100
    )
    return found.select(F.lower("canonical_ticker").alias("ticker"), "security_id", "price_bar_count")


@query("active_stock_count", """
SELECT count(*) AS assets FROM asset WHERE lower(asset_type) = 'stock' AND upper(substr(coalesce(currency, 'USD'), 1, 3)) = 'USD' AND is_active""")
def active_stock_count(p: Panels):
    return staging.stage_assets(p.asset).agg(F.count_if(universe.is_active_dollar_stock()).alias("assets"))


@query("member_price_coverage", """
SELECT m.security_id, coalesce(c.price_bar_count, 0) AS price_bar_count,
       CASE WHEN c.security_id IS NULL THEN 'missing_prices' ELSE 'eligible' END AS eligibility_status
FROM (SELECT security_id FROM security UNION ALL SELECT security_id + 500 FROM security) m
LEFT JOIN coverage c ON c.security_id = m.security_id""")
def member_price_coverage(p: Panels):
    ids = p.security.select("security_id")
    members = ids.unionByName(ids.select((F.col("security_id") + 500).alias("security_id")))
    return universe.member_coverage(members, seen_bars(p)).select("security_id", "price_bar_count", "eligibility_status")


@query("mapping_candidates", """
SELECT m.ticker, CASE WHEN m.security_id % 3 = 0 THEN NULL ELSE m.sector END AS sector FROM security m""")
def mapping_candidates(p: Panels):
    staged = staging.stage_companies(p.security.where("security_id % 3 <> 0"))
    return universe.mapping_candidates(p.security.select("ticker", "security_id"), staged).select("ticker", "sector")


@query("unmapped_candidates", """
SELECT 'classification' AS missing, security_id FROM candidates WHERE security_id % 5 <> 0
UNION ALL SELECT 'basket', security_id FROM candidates WHERE security_id % 4 <> 0
UNION ALL SELECT 'exposure', company_id FROM (SELECT DISTINCT company_id FROM candidates) c WHERE company_id % 6 <> 0""")
def unmapped_candidates(p: Panels):
    c = p.candidates
    some = universe.unmapped(c, p.classification.where("security_id % 5 = 0")).select(
        F.lit("classification").alias("missing"), "security_id"
    )
    baskets = p.peer_basket.withColumn("source", F.when(F.col("target_security_id") % 4 == 0, "curated").otherwise("generated"))
    bare = universe.without_curated_basket(c, baskets, "generated").select(F.lit("basket").alias("missing"), "security_id")
    made = exposures.sector_macro_exposures(c).where("exposure_name = 'rates'")
    held = made.select(
        "company_id", "exposure_name", F.when(F.col("company_id") % 6 == 0, "curated").otherwise("auto").alias("model_version")
    )
    open_ = universe.without_curated_exposure(made, held, "auto").select(
        F.lit("exposure").alias("missing"), F.col("company_id").alias("security_id")
    )
    return some.unionByName(bare).unionByName(open_)


@query("alias_ranked_prices", """
SELECT x.security_id, x.attempt, count(*) AS rows FROM (
  SELECT s.security_id, CASE WHEN s.security_id % 2 = 0 THEN 1 ELSE 0 END AS attempt, lower(s.ticker) AS ticker FROM security s) x
JOIN price_feed p ON p.ticker = x.ticker GROUP BY 1, 2""")
def alias_ranked_prices(p: Panels):
    low, even = F.lower("ticker"), F.col("security_id") % 2 == 0
    attempts = F.when(even, F.array(F.lit("ghost"), low)).otherwise(F.array(low, F.lit("nation_1")))
    wanted = p.security.select("security_id", attempts.alias("attempts"))
    return universe.first_alias_with_rows(wanted, p.price_feed).groupBy("security_id", "attempt").agg(
        F.count("*").alias("rows")
    )


@query("data_coverage", """
SELECT 'universe_members' AS metric, CAST(count(*) AS VARCHAR) AS value FROM security
UNION ALL SELECT 'eligible_members', CAST(count(*) FILTER (WHERE security_id % 4 <> 0) AS VARCHAR) FROM security
UNION ALL SELECT 'priced_members', CAST(count(*) AS VARCHAR) FROM security WHERE security_id IN (SELECT security_id FROM price_raw)
UNION ALL SELECT 'missing_price_members', CAST(count(*) AS VARCHAR) FROM security WHERE security_id NOT IN (SELECT security_id FROM price_raw)
UNION ALL SELECT 'price_bar_rows', CAST(count(*) AS VARCHAR) FROM price_raw
UNION ALL SELECT 'latest_price_date', CAST(max(event_date) AS VARCHAR) FROM price_raw
UNION ALL SELECT 'event_rows', CAST(count(*) AS VARCHAR) FROM event""")
def data_coverage(p: Panels):
    members = p.security.withColumn("eligibility_status", F.when(F.col("security_id") % 4 != 0, "eligible"))
    return reports.data_coverage(members, p.price_raw, {"event": p.event})


@query("series_coverage", """
SELECT 'factor' AS kind, factor_family AS name, count(*) AS rows FROM factor_return
WHERE event_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 2
UNION ALL SELECT 'macro', series_name, count(*) FROM macro_series WHERE event_date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' GROUP BY 2""")
def series_coverage(p: Panels):
    span = ("1997-01-01", "1998-12-31")
    f = reports.count_by(p.factor_return, "factor_family", *span).select(
        F.lit("factor").alias("kind"), F.col("factor_family").alias("name"), "rows"
    )
    m = reports.count_by(p.macro_series, "series_name", *span).select(
        F.lit("macro").alias("kind"), F.col("series_name").alias("name"), "rows"
    )
    return f.unionByName(m)


@query("usable_peer_baskets", """
SELECT count(*) AS usable_peer_baskets FROM (SELECT peer_basket_id FROM peer_member GROUP BY 1 HAVING count(*) >= 3) m""")
def usable_peer_baskets(p: Panels):
    return reports.usable_baskets(p.peer_member)


@query("feedback_verdicts", """
SELECT feedback_id, CASE WHEN feedback NOT IN ('correct', 'partially_correct', 'wrong', 'missing_driver') THEN 'feedback not allowed'
  WHEN feedback = 'missing_driver' AND coalesce(missing_driver_name, '') = '' THEN 'missing_driver needs a name'
  WHEN run_id >= 30 THEN 'attribution run not found'
  WHEN contribution_id IS NOT NULL AND contribution_id % 40 <> run_id THEN 'contribution not found for run' END AS rejection_reason
FROM feedback""")
def feedback_verdicts(p: Panels):
    runs = p.feedback.select("run_id").where("run_id < 30").distinct()
    parts = p.feedback.select((F.col("contribution_id") % 40).alias("run_id"), "contribution_id").where(
        "contribution_id IS NOT NULL"
    )
    return reports.feedback_verdicts(p.feedback, runs, parts).select("feedback_id", "rejection_reason")

"""Filing-text corpus: parsing, validation, duplicate accessions, scan counts and promotion to events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.functions.identity import canonical_ticker, looks_preferred, md5_uuid
from returnlens.functions.parsing import calendar_date, utc_timestamp
from returnlens.operators.pit import active_ticker_map, top_rows
from returnlens.operators.quality import issues

FILE_NAME = r"(?i)^(.+)-(\d{10}-\d{2}-\d{6})\.jsonl$"
RECORD = (
    "doc_id string, ticker string, date string, source string, title string, source_type string, source_url string, "
    "published_at string, available_at string, observed_at string, ingested_at string, content_hash string, text string"
)


def read_filings(spark: SparkSession, path: str) -> DataFrame:
    """First record of each file with the file's name."""
    lines = spark.read.schema(RECORD).json(path, recursiveFileLookup=True, pathGlobFilter="*.jsonl")
    named = lines.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("path"),
                         F.col("_metadata.file_block_start").alias("_at"))
    numbered = named.withColumn("_line", F.monotonically_increasing_id())
    return top_rows(numbered, ["path"], [F.col("_at").asc(), F.col("_line").asc()]).drop("_at", "_line")


def clean_text(text: Column) -> Column:
    """Line feeds only, no NUL, no white space at either end."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\x00", "")
    return F.regexp_replace(lines, r"^\s+|\s+$", "")


def check_filings(records: DataFrame) -> DataFrame:
    """Records with parsed name, cleaned-text measures and the reason for refusal, null when valid.

    The text itself leaves the row here; its hash and lengths stay.
    """
    ticker = F.upper(F.regexp_extract("file_name", FILE_NAME, 1))
    accession = F.regexp_extract("file_name", FILE_NAME, 2)
    payload_ticker = F.upper(F.coalesce(F.nullif("ticker", F.lit("")), ticker))
    cleaned = clean_text(F.col("text"))
    blank = F.coalesce(F.length(F.regexp_replace("text", r"^\s+", "")) == 0, F.lit(True))
    reason = (
        F.when(accession == "", "file name does not match")
        .when(F.coalesce("doc_id", F.lit("")) != accession, "accession does not match doc_id")
        .when(payload_ticker != ticker, "ticker does not match payload")
        .when(blank, "missing filing text")
        .when(utc_timestamp(F.col("available_at")).isNull(), "missing availability")
    )
    title = F.coalesce(F.nullif("title", F.lit("")), F.nullif("source_type", F.lit("")), F.lit("SEC filing"))
    return records.select(
        "path",
        ticker.alias("source_ticker"),
        canonical_ticker(ticker).alias("canonical_ticker"),
        accession.alias("accession_number"),
        F.upper(title).alias("form_type"),
        calendar_date(F.col("date")).alias("filing_date"),
        utc_timestamp(F.col("published_at")).alias("published_at"),
        utc_timestamp(F.col("available_at")).alias("available_at"),
        utc_timestamp(F.col("ingested_at")).alias("source_ingested_at"),
        "source_url",
        "content_hash",
        F.sha2(cleaned, 256).alias("text_sha256"),
        F.length("text").alias("raw_length"),
        F.length(cleaned).alias("text_length"),
        reason.alias("rejection_reason"),
    )


def valid(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("rejection_reason").isNull())


def canonical_tickers(candidates: DataFrame) -> DataFrame:
    """Ticker that speaks for each accession: not a preferred share, then shortest, then alphabetical."""
    ticker = F.col("canonical_ticker")
    distinct = candidates.select("accession_number", "canonical_ticker").distinct()
    return top_rows(
        distinct, ["accession_number"], [looks_preferred(ticker).asc(), F.length(ticker).asc(), ticker.asc()]
    ).withColumnRenamed("canonical_ticker", "chosen_ticker")


def choose_filings(candidates: DataFrame) -> DataFrame:
    """One candidate per accession: matching ticker first, then longest text, then path."""
    chosen = canonical_tickers(candidates)
    joined = candidates.join(chosen, "accession_number")
    best = top_rows(
        joined,
        ["accession_number"],
        [
            (F.col("canonical_ticker") != F.col("chosen_ticker")).asc(),
            F.col("text_length").desc(),
            F.col("path").asc(),
        ],
    )
    return best.withColumn("canonical_ticker", F.col("chosen_ticker")).drop("chosen_ticker")


def accession_aliases(candidates: DataFrame) -> DataFrame:
    """Every source ticker an accession was seen under, one row each."""
    return candidates.select("accession_number", "source_ticker").distinct()


def accession_duplicates(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("accession_number").agg(
        F.count("*").alias("copies"), F.count_distinct("text_sha256").alias("hashes")
    )


def mixed_hash_issues(candidates: DataFrame) -> DataFrame:
    mixed = accession_duplicates(candidates).where((F.col("copies") > 1) & (F.col("hashes") > 1))
    return issues(
        mixed,
        "warning",
        "duplicate_accession_mixed_hash",
        "filings",
        F.col("accession_number"),
        F.to_json(F.struct("copies", "hashes")),
    )


def rejection_issues(checked: DataFrame) -> DataFrame:
    refused = checked.where(F.col("rejection_reason").isNotNull())
    return issues(refused, "error", "filing_rejected", "filings", F.col("path"), F.col("rejection_reason"))


def scan_report(checked: DataFrame) -> DataFrame:
    """Corpus counts as rows of (metric, value), with one row per form."""
    good = valid(checked)
    per_accession = accession_duplicates(good)
    per_hash = good.groupBy("text_sha256").agg(F.count("*").alias("n"))

    def metric(name: str, df: DataFrame, value: Column) -> DataFrame:
        return df.agg(value.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    rows = [
        metric("files_seen", checked, F.count("*")),
        metric("rejected_records", checked, F.count("rejection_reason")),
        metric("valid_records", good, F.count("*")),
        metric("unique_accessions", per_accession, F.count("*")),
        metric("duplicate_accessions", per_accession, F.count_if(F.col("copies") > 1)),
        metric("duplicate_hashes", per_hash, F.count_if(F.col("n") > 1)),
        metric("source_tickers", good, F.count_distinct("source_ticker")),
        good.groupBy(F.concat(F.lit("form:"), F.upper("form_type")).alias("metric")).agg(F.count("*").alias("value")),
    ]
    return reduce(DataFrame.unionByName, rows)


def promote_filings(filings: DataFrame, aliases: DataFrame, securities: DataFrame, history: DataFrame, source: str) -> DataFrame:
    """Catalogued filings as events of their ticker's active security."""
    owner = (
        active_ticker_map(history)
        .join(securities.select("security_id", "company_id"), "security_id")
        .select(F.col("ticker").alias("canonical_ticker"), "security_id", "company_id")
    )
    names = aliases.groupBy("accession_number").agg(F.count("*").alias("source_ticker_count"))
    payload = F.to_json(
        F.struct(
            "canonical_ticker",
            "source_ticker_count",
            "source_url",
            F.col("path").alias("source_path"),
            "content_hash",
            "text_sha256",
            "filing_date",
            F.lit(source).alias("source"),
        )
    )
    return filings.join(owner, "canonical_ticker").join(names, "accession_number").select(
        md5_uuid(F.lit(source), F.col("accession_number")).alias("event_id"),
        "company_id",
        "security_id",
        F.col("form_type").alias("event_type"),
        F.lit(source).alias("source"),
        F.col("accession_number").alias("source_id"),
        payload.alias("structured_payload"),
        F.coalesce("published_at", "available_at").alias("event_time"),
        F.coalesce("source_ingested_at", "available_at").alias("ingestion_time"),
        F.col("available_at").alias("timestamp_available"),
    )

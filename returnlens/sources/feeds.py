"""Raw feeds to typed rows. Parsers take one payload per row, so a folder of files is ``read_payloads`` away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.functions.identity import clean_label, normalize_cik, normalize_ticker
from returnlens.functions.parsing import midnight

PRICE_ROW = (
    "struct<date: string, open: double, high: double, low: double, close: double, adjClose: double, volume: bigint>"
)
# Marks for a missing factor value.
FACTOR_MISSING = ["", "-99.99", "-999"]


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as rows of ``payload`` and ``file_name``."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_name").alias("file_name")
    )


def parse_prices(payloads: DataFrame, ingestion_time: str) -> DataFrame:
    """Daily price JSON, a list or an object with a ``historical`` list, to bars."""
    text = F.col("payload")
    listed = F.from_json(text, f"array<{PRICE_ROW}>")
    wrapped = F.from_json(text, f"struct<historical: array<{PRICE_ROW}>>").getField("historical")
    rows = F.when(F.ltrim(text).startswith("["), listed).otherwise(wrapped)
    at = F.lit(ingestion_time).cast("timestamp_ntz")
    day = F.to_date("r.date", "yyyy-MM-dd")
    return payloads.select(F.upper("ticker").alias("ticker"), F.explode(rows).alias("r")).where("r IS NOT NULL").select(
        "ticker",
        day.alias("event_date"),
        midnight(day).alias("event_time"),
        at.alias("ingestion_time"),
        at.alias("timestamp_available"),
        "r.open",
        "r.high",
        "r.low",
        "r.close",
        F.coalesce("r.adjClose", "r.close").alias("adjusted_close"),
        "r.volume",
    )


def parse_five_factors(payloads: DataFrame, start: str, end: str, ingestion_time: str) -> DataFrame:
    """Daily factor CSV: the block between the ``Mkt-RF`` header and the first row without a numeric date.

    Positions are found inside each payload, so the file keeps its line order whatever the partitioning.
    """
    lines = F.split("payload", r"\r?\n")
    is_header = lambda line: line.rlike(r"^\s*,") & line.rlike(r"(^|,)\s*Mkt-RF\s*(,|$)")
    flags = F.transform("lines", is_header)
    cut = (
        payloads.select("payload", lines.alias("lines"))
        .withColumn("head", F.array_position(flags, F.lit(True)).cast("int"))
        .where("head > 0")
        .withColumn("names", F.transform(F.split(F.element_at("lines", F.col("head")), ","), lambda s: F.trim(s)))
        .withColumn("names", F.filter(F.expr("slice(names, 2, size(names))"), lambda s: s != ""))
        .withColumn("rest", F.expr("slice(lines, head + 1, size(lines))"))
        .withColumn(
            "stop",
            F.array_position(F.transform("rest", lambda line: ~line.rlike(r"^\s*[0-9]+\s*(,|$)")), F.lit(True)).cast("int"),
        )
        .withColumn("block", F.expr("CASE WHEN stop = 0 THEN rest ELSE slice(rest, 1, stop - 1) END"))
    )
    cells = cut.select("names", F.explode("block").alias("line")).select("names", F.split("line", ",").alias("cells"))
    day = F.to_date(F.trim(F.element_at("cells", 1)), "yyyyMMdd")
    dated = cells.withColumn("event_date", day).where(
        F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    values = F.expr("slice(cells, 2, size(cells))")
    paired = dated.withColumn("pair", F.explode(F.arrays_zip("names", values.alias("raw"))))
    raw = F.trim(F.col("pair.raw"))
    at = F.lit(ingestion_time).cast("timestamp_ntz")
    return paired.where(
        F.col("pair.names").isNotNull() & raw.isNotNull() & ~raw.isin(FACTOR_MISSING)
    ).select(
        F.col("pair.names").alias("factor_name"),
        "event_date",
        raw.cast("double").alias("raw_percent_return"),
        (raw.cast("double") * 100.0).alias("return_bps"),
        at.alias("ingestion_time"),
        at.alias("timestamp_available"),
    )


def parse_macro(rows: DataFrame, start: str, end: str, ingestion_time: str) -> DataFrame:
    """Header-read macro CSV rows with ``series_name`` added: either date column, value under series name or VALUE."""

    def named(*names: str) -> Column:
        held = [F.nullif(F.col(f"`{n}`"), F.lit("")) for n in names if n in rows.columns]
        return F.coalesce(*held, F.lit(None).cast("string"))

    series = [c for c in rows.columns if c not in ("observation_date", "DATE", "VALUE", "series_name")]
    own = [F.when(F.col("series_name") == s, F.nullif(F.col(f"`{s}`"), F.lit(""))) for s in series]
    value = F.coalesce(*own, named("VALUE"))
    day = F.to_date(named("observation_date", "DATE"), "yyyy-MM-dd")
    at = F.lit(ingestion_time).cast("timestamp_ntz")
    return (
        rows.select("series_name", day.alias("event_date"), value.alias("raw"))
        .where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .where(F.col("raw").isNotNull() & (F.col("raw") != "."))
        .select(
            "series_name",
            "event_date",
            F.col("raw").cast("double").alias("value"),
            F.lit(None).cast("string").alias("vintage"),
            at.alias("ingestion_time"),
            at.alias("timestamp_available"),
        )
    )


def parse_submissions(payloads: DataFrame, ingestion_time: str) -> DataFrame:
    """Columnar filing lists to one row per filing; short lists leave nulls at their tail."""
    # Public field names of the filing index.
    fields = ["form", "accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "primaryDocument"]
    recent = ", ".join(f"{f}: array<string>" for f in fields)
    parsed = F.from_json("payload", f"struct<name: string, filings: struct<recent: struct<{recent}>>>")
    lists = payloads.select(normalize_cik(F.col("cik")).alias("cik"), parsed.alias("p")).select(
        "cik", "p.name", "p.filings.recent.*"
    )
    n = F.size("form")
    fitted = [F.expr(f"slice(coalesce({f}, array()), 1, greatest(size(form), 0))").alias(f) for f in fields]
    rows = lists.where(n > 0).select("cik", "name", F.explode(F.arrays_zip(*fitted)).alias("f"))
    at = F.lit(ingestion_time).cast("timestamp_ntz")
    text = F.col("f.acceptanceDateTime")
    zone = r"(Z|[+-][0-9]{2}:[0-9]{2})$"
    accepted = F.when(F.contains(text, F.lit("T")), F.to_timestamp_ntz(F.regexp_replace(text, zone, "")))
    filed = F.to_date(F.nullif("f.filingDate", F.lit("")))
    return rows.select(
        "cik",
        F.coalesce("name", F.lit("")).alias("company_name"),
        F.col("f.form").alias("form"),
        F.col("f.accessionNumber").alias("accession_number"),
        filed.alias("filing_date"),
        F.to_date(F.nullif("f.reportDate", F.lit(""))).alias("report_date"),
        F.nullif("f.primaryDocument", F.lit("")).alias("primary_document"),
        F.coalesce(accepted, midnight(filed)).alias("event_time"),
        at.alias("ingestion_time"),
        F.coalesce(accepted, at).alias("timestamp_available"),
    )


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """Universe configuration file to one row per listed security."""
    listed = (
        "struct<version: string, source: string, active_from: string, timestamp_available: string, securities: "
        "array<struct<ticker: string, name: string, cik: string, exchange: string, sector: string, industry: string, "
        "subindustry: string, vendor_aliases: array<string>, peers: array<string>, exposures: map<string, double>>>>"
    )
    files = read_payloads(spark, path).select(F.from_json("payload", listed).alias("u"))
    return universe_rows(files.select("u.*"))


def universe_rows(config: DataFrame) -> DataFrame:
    """Listed securities with normalised names; missing labels become Unknown."""
    unknown = F.lit("Unknown")
    return config.select("version", "source", "active_from", F.explode("securities").alias("s")).select(
        "version",
        "source",
        "active_from",
        normalize_ticker(F.col("s.ticker")).alias("ticker"),
        F.col("s.name").alias("name"),
        normalize_cik(F.col("s.cik")).alias("cik"),
        F.coalesce(F.nullif("s.exchange", F.lit("")), F.lit("UNKNOWN")).alias("exchange"),
        F.coalesce(clean_label(F.col("s.sector")), unknown).alias("sector"),
        F.coalesce(clean_label(F.col("s.industry")), unknown).alias("industry"),
        F.coalesce(clean_label(F.col("s.subindustry")), clean_label(F.col("s.industry")), unknown).alias("subindustry"),
        F.col("s.vendor_aliases").alias("vendor_aliases"),
        F.col("s.peers").alias("peers"),
        F.col("s.exposures").alias("exposures"),
    )


def read_staging_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, properties: dict) -> DataFrame:
    """Source table over JDBC in key ranges, so executors read it in parallel."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=low, upperBound=high, numPartitions=parts,
        properties={"fetchsize": "10000", **properties},
    )

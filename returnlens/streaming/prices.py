"""Price files arriving in a landing folder, kept as an append-only table of visible versions.

Every micro-batch owns one partition and overwrites it when replayed, so each file counts once; readers pick the latest
visible version of a bar as they do for any other source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from returnlens.sources.feeds import parse_prices

FILE_TICKER = r"^(.+)\.json$"


def landed_prices(spark: SparkSession, landing: str) -> DataFrame:
    """Stream of whole price files named after their ticker."""
    files = spark.readStream.format("text").option("wholetext", True).load(landing)
    name = F.regexp_extract(F.col("_metadata.file_name"), FILE_TICKER, 1)
    return files.select(F.col("value").alias("payload"), name.alias("ticker"))


def append_prices(payloads: DataFrame, table: str, checkpoint: str, ingestion_time: str, source: str) -> StreamingQuery:
    """Parse arriving payloads and write each batch's bars to its own partition."""

    def write(batch: DataFrame, batch_id: int) -> None:
        bars = parse_prices(batch, ingestion_time).withColumn("source", F.lit(source))
        bars.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return (
        payloads.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Structured Streaming over documents: canonical form, hash and issues for each record as it comes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canonframe.functions.documents import canonicalize_report


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A stream of NDJSON lines: data."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.where(F.trim("value") != "").select(F.col("value").alias("data"))


def canonical_stream(stream: DataFrame, data: str = "data", **options) -> DataFrame:
    """stream with canon, canon_sha256, error: bad records are kept as data, never stop the query."""
    report = stream.withColumn("__r", canonicalize_report(data, **options))
    return report.withColumn("canon", F.decode(F.col("__r.canon"), "UTF-8")).withColumn("canon_sha256", F.sha2(F.col("__r.canon"), 256)).withColumn("error", F.col("__r.error")).drop("__r")


def distinct_within(stream: DataFrame, event_time: str, delay: str = "10 minutes", key: str = "canon_sha256") -> DataFrame:
    """An extension: the first record of each canonical content within the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def write_stream(stream: DataFrame, path: str, checkpoint: str):
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Scans of landed responses and of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EVENTS


def pages_as_responses(pages: DataFrame) -> DataFrame:
    """A table (page_id, url, html) in the response layout."""
    return pages.select(
        F.col("page_id").alias("response_id"),
        "url",
        F.lit(200).alias("status"),
        F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8")).alias("headers"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.encode("html", "UTF-8").alias("body"),
    )


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return pages_as_responses(spark.read.parquet(path))


def read_files(spark: SparkSession, path: str, content_type: str, glob: str | None = None) -> DataFrame:
    """Landed files, one response each; the URL is the file's path."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        F.xxhash64("path").alias("response_id"),
        F.col("path").alias("url"),
        F.lit(200).alias("status"),
        F.create_map(F.lit("content-length"), F.col("length").cast("string")).alias("headers"),
        F.lit(content_type).alias("content_type"),
        F.col("content").alias("body"),
        F.col("modificationTime").alias("fetched_at"),
    )


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Newline-delimited JSON events; blank lines are skipped, malformed ones become NULL rows."""
    reader = (spark.readStream if stream else spark.read).schema(EVENTS).option("mode", "PERMISSIVE")
    return reader.json(path)

"""Exports: guarded CSV, JSON results and event lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"
GUARD = r"(?U)^[\s\x{FEFF}]*[=+@-]|^[\t\r\n]"


def csv_cell(c: Column) -> Column:
    """A quoted cell; text a spreadsheet would run as a formula gets a leading apostrophe."""
    text = F.coalesce(c, F.lit(""))
    safe = F.when(text.rlike(GUARD), F.concat(F.lit("'"), text)).otherwise(text)
    return F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))


def csv_line(columns: Sequence[str]) -> Column:
    return F.concat_ws(",", *[csv_cell(F.col(f"`{c}`")) for c in columns])


def _header(columns: Sequence[str]) -> Column:
    return F.concat(F.lit(BOM), F.concat_ws(",", *[csv_cell(F.lit(c)) for c in columns]))


def write_csv(df: DataFrame, path: str, fields: Sequence[str]) -> None:
    """Each part file is a complete CSV: byte order mark, header, then its rows, CRLF between.

    The first row of a task carries the header in front, so nothing is gathered in one task; a task writes
    one file, whatever the session says about rows per file. An empty view gives a file with the header.
    """
    columns = [*fields, "_source"]
    header = _header(columns)
    in_task = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = csv_line(columns)
    marked = F.when(in_task == 0, F.concat(header, F.lit("\r\n"), line)).otherwise(line)

    def write(lines: DataFrame, mode: str) -> None:
        lines.write.mode(mode).option("lineSep", "\r\n").option("maxRecordsPerFile", 0).text(path)

    write(df.select(marked.alias("value")), "errorifexists")
    spark = df.sparkSession
    if spark.read.text(path).isEmpty():
        write(spark.range(0, 1, 1, 1).select(header.alias("value")), "append")


def csv_parts(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """(path, length, headed, row_bytes) of the part files below ``path`` that aren't empty: whether each starts
    with mark and header, and how many bytes follow them.

    Parts may be of any size: they are read line by line, and only sizes go on.
    """
    header = _header([*fields, "_source"])
    lines = spark.read.option("lineSep", "\r\n").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").text(path)
    at_start = F.col("_metadata.file_block_start") == 0
    lines = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("length"),
        (F.octet_length("value") + 2).cast("long").alias("_bytes"),
        # the lines of a block come in their order; long ones are cut, as only the header is looked for
        F.when(at_start, F.monotonically_increasing_id()).alias("_at"),
        F.when(at_start, F.left("value", F.length(header) + 1)).alias("_line"),
    )
    read = lines.groupBy("path", "length").agg(F.sum("_bytes").alias("_bytes"), F.min_by("_line", "_at").alias("_first"))
    # Spark's reader leaves out the mark, so a file that has one is longer by it than its lines
    headed = (F.concat(F.lit(BOM), F.col("_first")) == header) & (F.col("length") == F.col("_bytes") + F.octet_length(F.lit(BOM)))
    return read.select("path", "length", headed.alias("headed"), (F.col("length") - F.octet_length(header) - 2).alias("row_bytes"))


def iso_time(ms: Column) -> Column:
    """Milliseconds since 1970 as an ISO 8601 time in UTC, whatever the session's time zone is."""
    utc = F.expr("timestamp_ntz '1970-01-01 00:00:00'") + F.make_dt_interval(secs=(ms / 1000).cast("decimal(18,6)"))
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def write_result(
    view: DataFrame, fields: Sequence[str], path: str, *, original: DataFrame, filters: dict, pages: DataFrame, warnings: DataFrame
) -> None:
    """A whole result below ``path``: ``rows``, ``pages`` and ``warnings`` as JSON lines, which may be of any
    number, and one ``result`` document with fields, duration, completedAt and selection.

    ``pages`` has url, title, started_ms and finished_ms, ``warnings`` has message and pos. The rows are those
    of the view with their source, the selection counts the original rows.
    """
    view.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in (*fields, "_source")])).alias("value")).write.text(f"{path}/rows")
    took = (F.col("finished_ms") - F.col("started_ms")).alias("duration")
    pages.select(F.to_json(F.struct("url", "title", "rows", took)).alias("value")).write.text(f"{path}/pages")
    first = warnings.groupBy("message").agg(F.min("pos").alias("pos"))
    first.select(F.to_json(F.struct("pos", "message")).alias("value")).write.text(f"{path}/warnings")
    times = pages.agg(F.min("started_ms").alias("start"), F.max("finished_ms").alias("end"))
    counted = original.agg(F.count(F.lit(1)).alias("originalCount"))
    chosen = F.create_map(*[F.lit(x) for k, v in filters.items() for x in (k, str(v))]) if filters else F.create_map().cast("map<string,string>")
    document = F.struct(
        F.array(*[F.lit(f) for f in fields]).cast("array<string>").alias("fields"),
        (F.col("end") - F.col("start")).alias("duration"),
        iso_time(F.col("end")).alias("completedAt"),
        F.struct("originalCount", chosen.alias("filters")).alias("selection"),
    )
    # one row each
    times.join(counted).select(F.to_json(document).alias("value")).write.text(f"{path}/result")


def read_result(spark: SparkSession, path: str, fields: Sequence[str]) -> dict[str, DataFrame]:
    """The four parts of a written result."""
    schemas = {
        "rows": ", ".join(f"`{c}` string" for c in (*fields, "_source")),
        "pages": "url string, title string, rows long, duration long",
        "warnings": "pos long, message string",
        "result": "fields array<string>, duration long, completedAt string, selection struct<originalCount:long,filters:map<string,string>>",
    }
    return {part: spark.read.schema(schema).json(f"{path}/{part}") for part, schema in schemas.items()}


def write_result_json(
    view: DataFrame, fields: Sequence[str], path: str, *, original: DataFrame, filters: dict
) -> None:
    """Selected rows as JSON lines below ``rows`` and one ``selection`` document beside them."""
    view.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in (*fields, "_source")])).alias("value")).write.text(
        f"{path}/rows"
    )
    chosen = F.create_map(*[F.lit(x) for k, v in filters.items() for x in (k, str(v))]) if filters else F.create_map()
    original.agg(F.count(F.lit(1)).alias("originalCount")).select(
        F.to_json(F.struct(F.struct("originalCount", chosen.alias("filters")).alias("selection"))).alias("value")
    ).write.text(f"{path}/selection")


def event_line(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*columns))


def write_events(df: DataFrame, path: str) -> None:
    """One JSON event per line."""
    df.select(event_line(df.columns).alias("value")).write.text(path)

"""Gates over landed responses: status, content type, size, kind, charset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import CHARSET_PATTERN, CHARSETS, HTML_CONTENT_TYPE, JSON_CONTENT_TYPE
from ..functions.text import let

REASON = "reject_reason"


def split_rejects(gated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, rejected rows with their reason)."""
    return gated.filter(F.col(REASON).isNull()).drop(REASON), gated.filter(F.col(REASON).isNotNull())


def status_reason(status: Column) -> Column:
    return F.when(status.between(200, 299), F.lit(None)).otherwise(
        F.concat(F.lit("HTTP "), status.cast("string"), F.when(status == 403, " forbidden").otherwise(""))
    )


def content_type_reason(content_type: Column, kind: str) -> Column:
    pattern = JSON_CONTENT_TYPE if kind == "json" else HTML_CONTENT_TYPE
    return F.when(~F.coalesce(content_type, F.lit("")).rlike(pattern), f"not {kind}")


def size_reason(body: Column, declared: Column, max_bytes: int) -> Column:
    too_big = (F.octet_length(body) > max_bytes) | (F.coalesce(declared.try_cast("double"), F.lit(0)) > max_bytes)
    return F.when(too_big, "too large")


def gate(df: DataFrame, reason: Column) -> DataFrame:
    """Adds or keeps a reason; the first gate that rejects a row names it."""
    if REASON in df.columns:
        reason = F.coalesce(F.col(REASON), reason)
    return df.withColumn(REASON, reason)


def gate_status(responses: DataFrame) -> DataFrame:
    return gate(responses, status_reason(F.col("status")))


def gate_content_type(responses: DataFrame, kind: str) -> DataFrame:
    return gate(responses, content_type_reason(F.col("content_type"), kind))


def gate_size(responses: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Rejects bodies above ``max_bytes``; without a limit none."""
    if max_bytes is None:
        return gate(responses, F.lit(None).cast("string"))
    declared = F.try_element_at("headers", F.lit("content-length"))
    return gate(responses, size_reason(F.col("body"), declared, max_bytes))


def decode_utf8(body: Column) -> Column:
    """Body as UTF-8 text without one leading byte order mark."""
    return F.regexp_replace(F.decode(body, "UTF-8"), r"^\x{FEFF}", "")


def response_kind(content_type: Column, body: Column) -> Column:
    """json, html or NULL, from the header or the first characters after white space of any length."""
    kind = F.coalesce(content_type, F.lit(""))
    return let(
        F.decode(body, "UTF-8"),
        lambda t: F.when(kind.rlike(JSON_CONTENT_TYPE) | t.rlike(r"(?U)^[\s\x{FEFF}]*+[\[{]"), "json").when(
            kind.rlike(HTML_CONTENT_TYPE) | t.rlike(r"(?i)^(?U:[\s\x{FEFF}]*+)(?:<!doctype html|<html[\s>])"), "html"
        ),
    )


def classify(responses: DataFrame) -> DataFrame:
    return responses.withColumn("kind", response_kind(F.col("content_type"), F.col("body")))


def charset_of(content_type: Column, body: Column) -> Column:
    """JVM charset: byte order mark, then header, then meta tag, then UTF-8."""
    known = F.create_map(*[F.lit(x) for pair in CHARSETS.items() for x in pair])

    def named(label: Column) -> Column:
        return F.try_element_at(known, F.lower(F.nullif(label, F.lit(""))))

    mark = F.hex(F.substring(body, 1, 3))
    meta = F.regexp_extract(F.decode(body, "ISO-8859-1"), r"(?is)<meta[^>]*?charset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", 1)
    # A meta tag that could be read as bytes cannot be UTF-16
    meta_charset = F.regexp_replace(named(meta), "^UTF-16.E$", "UTF-8")
    header = F.regexp_extract(F.coalesce(content_type, F.lit("")), CHARSET_PATTERN, 1)
    return (
        F.when(mark == "EFBBBF", "UTF-8")
        .when(mark.startswith("FFFE"), "UTF-16LE")
        .when(mark.startswith("FEFF"), "UTF-16BE")
        .otherwise(F.coalesce(named(header), meta_charset, F.lit("UTF-8")))
    )


def decode_text(content_type: Column, body: Column) -> Column:
    charset = charset_of(content_type, body)
    # the common case stays a plain UTF-8 decode
    text = let(
        charset,
        lambda c: F.when(c == "UTF-8", F.decode(body, "UTF-8")).otherwise(F.call_function("decode", body, c)),
    )
    return F.regexp_replace(text, r"^\x{FEFF}", "")


def decode_body(responses: DataFrame, text: str = "html") -> DataFrame:
    """Replaces ``body`` by its text."""
    return responses.withColumn(text, decode_text(F.col("content_type"), F.col("body"))).drop("body")

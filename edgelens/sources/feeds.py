"""Nested feed responses flattened to table rows.

Every function takes a frame with one response document per row in a text
column and returns rows of one table, numbered in the order they were read. A
response that lacks the feed or holds no zone gives no rows; one that cannot be read
gives none either and is told by ``rejected``. All steps are map-side: no shuffle. A
stream is flattened batch by batch.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from edgelens import schemas as S
from edgelens.functions import timetext as T

# Longest look-back each feed serves, in hours.
FIREWALL_MAX_HOURS = 24
DETAILS_MAX_HOURS = 23


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one JSON document per line, kept as text with their arrival."""
    return spark.read.text(path).select(F.col("value").alias("payload"), _arrival())


def stream_landing(spark: SparkSession, path: str) -> DataFrame:
    """The same as an unbounded frame: files appear, rows follow."""
    return spark.readStream.text(path).select(F.col("value").alias("payload"), _arrival())


def _arrival() -> Column:
    """Order of landed files: by modification time, then path and block. Readers pack
    files by size, so their own order says nothing."""
    return F.struct(
        F.lit(None).cast("bigint").alias("run_seq"),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_path").alias("landed_file"),
        F.col("_metadata.file_block_start").alias("landed_block"),
    ).alias("arrival")


CORRUPT = "_corrupt_record"


def _document(feed: str) -> Column:
    schema = S.payload_schema(feed).add(CORRUPT, "string")
    return F.from_json("payload", schema, {"columnNameOfCorruptRecord": CORRUPT})


def rejected(landed: DataFrame, feed: str) -> DataFrame:
    """Responses that give no rows because they cannot be read, with the reason.

    ``not json`` is text that is no JSON document, such as the lines of a document
    that spans several; ``wrong type`` is JSON in which a value has another type than
    its field. A response without the feed is empty, not rejected.
    """
    document = F.rlike(F.trim("payload"), F.lit(r"^(?s)\{.*\}$")) & F.try_parse_json("payload").isNotNull()
    reason = F.when(document, "wrong type").otherwise("not json")
    bad = _document(feed).getField(CORRUPT).isNotNull()
    written = F.trim("payload") != ""
    return landed.where(bad & written).select(F.lit(feed).alias("feed"), reason.alias("reason"), *landed.columns)


def _entries(landed: DataFrame, feed: str, keep: list[str]) -> DataFrame:
    """One row per feed entry of the first zone of the responses that can be read.

    The document is parsed once: what is asked of it is asked inside one expression,
    and the outer form of explode keeps the optimizer from testing that expression
    in a filter of its own.
    """
    keep = keep + [c for c in landed.columns if c == "arrival"]
    readable = F.transform(
        F.array(_document(feed)),
        lambda doc: F.when(
            doc[CORRUPT].isNull(), F.get(doc["data"]["viewer"]["zones"], F.lit(0)).getField(feed)
        ),
    )
    exploded = landed.select(*keep, F.posexplode_outer(F.get(readable, F.lit(0))).alias("place", "entry"))
    return exploded.where(F.col("place").isNotNull()).drop("place")


def _read_order(landed: DataFrame) -> list[Column]:
    """Numbers that rise within a landed file, and the file's own arrival if known."""
    arrival = [F.col("arrival")] if "arrival" in landed.columns else []
    return [F.monotonically_increasing_id().alias("ingest_seq"), *arrival]


def _stamp(as_of: datetime | str | Column) -> Column:
    return T.iso_second(T.instant(as_of)).alias("collected_at")


def flatten_hourly(landed: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Hour groups to one row per country.

    A group without countries keeps its totals under ``Unknown``; only such a
    row carries the group's unique visitors.
    """
    groups = _entries(landed, S.HOURLY_FEED, [])
    per_country = groups.select(
        *(c for c in groups.columns if c == "arrival"),
        F.col("entry.dimensions.datetime").alias("bucket"),
        F.col("entry.sum").alias("total"),
        F.col("entry.uniq.uniques").alias("uniques"),
        F.posexplode_outer("entry.sum.countryMap").alias("position", "c"),
    )
    no_countries = F.col("position").isNull()

    def pick(total: str, part: str) -> Column:
        return F.when(no_countries, F.col(f"total.{total}")).otherwise(F.col(f"c.{part}"))

    return per_country.select(
        _stamp(as_of),
        "bucket",
        F.when(no_countries, F.lit("Unknown"))
        .otherwise(F.col("c.clientCountryName"))
        .alias("country"),
        F.lit("").alias("http_method"),
        F.lit(0).alias("status_code"),
        F.lit("").alias("content_type"),
        pick("requests", "requests").alias("request_count"),
        pick("bytes", "bytes").alias("bytes_total"),
        pick("threats", "threats").alias("threats"),
        F.when(no_countries, F.col("uniques")).otherwise(F.lit(0)).cast("bigint").alias("unique_visitors"),
        *_read_order(landed),
    )


def _or_empty(field: str, name: str) -> Column:
    return F.coalesce(F.col(f"entry.{field}"), F.lit("")).alias(name)


def flatten_firewall(landed: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Events under table names; absent text becomes empty, an absent id NULL."""
    return _entries(landed, S.FIREWALL_FEED, []).select(
        _stamp(as_of),
        _or_empty("datetime", "event_datetime"),
        _or_empty("action", "action"),
        _or_empty("clientIP", "client_ip"),
        _or_empty("clientCountryName", "country"),
        _or_empty("clientRequestHTTPHost", "host"),
        _or_empty("clientRequestHTTPMethodName", "http_method"),
        _or_empty("clientRequestPath", "request_path"),
        _or_empty("userAgent", "user_agent"),
        _or_empty("ruleId", "rule_id"),
        _or_empty("source", "source"),
        F.col("entry.rayName").alias("ray_name"),
        *_read_order(landed),
    )


def flatten_details(
    landed: DataFrame, as_of: datetime | str | Column, window_start: Column
) -> DataFrame:
    """Grouped counts; the bucket is the hour in which the pull window starts.

    ``window_start`` is ISO text, a constant of the pull or a column of ``landed``.
    """
    return _entries(landed, S.DETAILS_FEED, [T.hour_of_iso(window_start).alias("bucket")]).select(
        _stamp(as_of),
        "bucket",
        _or_empty("dimensions.clientCountryName", "country"),
        _or_empty("dimensions.clientRequestHTTPMethodName", "http_method"),
        F.col("entry.dimensions.edgeResponseStatus").alias("status_code"),
        _or_empty("dimensions.clientRequestPath", "path"),
        F.col("entry.count").alias("request_count"),
        *_read_order(landed),
    )

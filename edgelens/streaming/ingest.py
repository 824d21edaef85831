"""Streams over landed files that end when the files do (``availableNow``).

Each job is one call per scheduled run; the checkpoint folder carries what was
read over to the next. Sinks write tables, so nothing is gathered on the driver,
and every batch write is keyed by its batch number, so a replayed batch replaces
its own output.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from edgelens import schemas as S
from edgelens.functions import timetext as T
from edgelens.operators import maintain
from edgelens.session import exists
from edgelens.sources import feeds
from edgelens.sources.store import Store

# The payload name of each feed.
PAYLOADS = {"hourly": S.HOURLY_FEED, "firewall": S.FIREWALL_FEED, "details": S.DETAILS_FEED}
# Fixed value: hours may change this long after they end.
LATENESS = "25 hours"


def stream_files(
    spark: SparkSession, path: str, schema: StructType, pattern: str | None = None, files: int | None = None
) -> DataFrame:
    """Parquet files as a stream: all new ones in one batch, or ``files`` at a time."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def run_available(
    stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], mode: str = "append"
) -> int:
    """Process everything that is there, batch by batch; returns the last batch number."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    progress = query.lastProgress
    return -1 if progress is None else progress["batchId"]


def with_batch(schema: StructType) -> StructType:
    """The schema of a table written batch by batch."""
    return StructType([*schema.fields, StructField("batch", LongType())])


def append_rows(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Plain incremental append with the file sink's own exactly-once log."""
    (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def hourly_rollup(events: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Tumbling one-hour sums per key over ``ts``, with text buckets.

    Partial sums combine map-side before the state store sees them, so a busy
    key costs one row per task and batch.
    """
    sums = [c.alias(name) for name, c in measures.items()]
    return (
        events.groupBy(F.window("ts", "1 hour"), *keys)
        .agg(*sums)
        .select(T.iso_hour(F.col("window.start")).alias("bucket"), *keys, *measures)
    )


def settled_hours(events: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """The same for totals that overwrite stored hours: a key without value is
    ``Unknown`` before anything is summed, so that both have one total, and hours past
    the lateness are settled."""
    named = events.withColumns({k: F.coalesce(F.col(k), F.lit("Unknown")) for k in keys})
    return hourly_rollup(named.withWatermark("ts", LATENESS), keys, measures)


def rolling_totals(events: DataFrame, measures: dict[str, Column], days: int = 7, step_hours: int = 6) -> DataFrame:
    """Totals of every ``days`` window that starts on a ``step_hours`` mark, while they grow.

    An event lies in ``days * 24 / step_hours`` open windows. It fans out to them inside
    its task, where partial sums combine, so the shuffle and the state see one row per
    window and task. Windows that ended longer ago than the lateness leave the state.
    """
    span = F.window("ts", f"{days} days", f"{step_hours} hours")
    sums = [c.alias(name) for name, c in measures.items()]
    return (
        events.withWatermark("ts", LATENESS)
        .groupBy(span)
        .agg(*sums)
        .select(
            T.iso_second(F.col("window.start")).alias("window_start"),
            T.iso_second(F.col("window.end")).alias("window_end"),
            *measures,
        )
    )


def dedupe_recent(events: DataFrame, key: str = "ray_name") -> DataFrame:
    """First event per id within the lateness bound; the state forgets older ids.

    Ids are near unique, so the shuffle by id is even. Events with an empty id, or none,
    would all meet in one task and take another branch past the state;
    ``insert_recent`` keeps one of the empty ids, by an aggregation that combines map-side.
    """
    named = events.where(F.col(key) != "").withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark([key])
    return named.unionByName(events.where(F.coalesce(F.col(key), F.lit("")) == ""))


def insert_recent(stream: DataFrame, checkpoint: str, path: str, key: str = "ray_name") -> None:
    """Append the batches of ``dedupe_recent``: named events are single, events without
    an id all stay, of those with an empty id the first ever stays.

    A batch writes its own folder, so a replay replaces it; whether an empty id is stored
    is asked of the batches before it.
    """
    spark = stream.sparkSession
    stored = with_batch(stream.schema)

    def write(batch: DataFrame, number: int) -> None:
        rows = maintain.first_write_wins(batch)
        if exists(spark, path):
            before = spark.read.schema(stored).parquet(path).where((F.col("batch") < number) & (F.col(key) == ""))
            if not before.isEmpty():
                rows = rows.where(F.col(key).isNull() | (F.col(key) != ""))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(stream, checkpoint, write)


def write_changes(stream: DataFrame, checkpoint: str, path: str) -> None:
    """Append what each batch changed, in a folder per batch that a replay replaces."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(stream, checkpoint, write, "update")


def newest_changes(spark: SparkSession, path: str, schema: StructType, key: list[str]) -> DataFrame:
    """The last change of every key."""
    rows = spark.read.schema(with_batch(schema)).parquet(path)
    rest = [c for c in schema.fieldNames() if c not in key]
    last = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("last"))
    return last.select(*key, "last.*")


def write_totals(stream: DataFrame, checkpoint: str, path: str) -> str:
    """Exact totals of everything read so far; returns the folder of the newest."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return f"{path}/batch={run_available(stream, checkpoint, write, 'complete')}"


def upsert_hours(stream: DataFrame, checkpoint: str, store: Store, run: str, mode: str = "update") -> None:
    """Overwrite the hours a batch changed (last write wins).

    Update mode sends running totals that must replace the ones before, so their
    key may hold no NULL (``settled_hours`` sees to that). Append mode sends pulled
    rows as they are.
    """

    def write(batch: DataFrame, number: int) -> None:
        if mode == "update":
            batch = batch.withColumn("ingest_seq", F.lit(number).cast("bigint"))
        store.load(f"{run}-{number:08d}", hourly=batch)

    run_available(stream, checkpoint, write, mode)


def insert_new_events(stream: DataFrame, checkpoint: str, store: Store, run: str) -> None:
    """Insert events whose id no earlier batch or run has stored (first write wins)."""

    def write(batch: DataFrame, number: int) -> None:
        store.load(f"{run}-{number:08d}", firewall=batch)

    run_available(stream, checkpoint, write)


def load_landed(
    store: Store,
    landing: str,
    checkpoint: str,
    as_of: datetime | str,
    details_from: Column,
    run: str,
    only: set[str] | None = None,
) -> None:
    """Load what landed since the last call, feed by feed, under the table rules.

    Batches carry the feed and their number in the name of their run, whatever ``run``
    calls the pull; a batch that is replayed is skipped. Responses that cannot be read
    are published under ``rejected``.

    Each feed keeps its own place, so feeds may arrive at different times;
    ``jobs.collect`` is the form that loads the three of a pull together.
    """
    flatten = {
        "hourly": lambda rows: feeds.flatten_hourly(rows, as_of),
        "firewall": lambda rows: feeds.flatten_firewall(rows, as_of),
        "details": lambda rows: feeds.flatten_details(rows, as_of, details_from),
    }
    for feed, rows_of in flatten.items():

        if only is not None and feed not in only:
            continue

        def write(batch: DataFrame, number: int) -> None:
            name = f"{run}-{feed}-{number:08d}"
            store.reject(name, feeds.rejected(batch, PAYLOADS[feed]))
            store.load(name, **{feed: rows_of(batch)})

        landed = feeds.stream_landing(store.spark, f"{landing}/{feed}")
        run_available(landed, f"{checkpoint}/{feed}", write)

"""Key rules of the tables: last write wins, first write wins, repair of NULL keys.

Each rule picks one row per key by ``row_number() = 1``. Spark applies that rank
limit before the shuffle too, so a key that holds a large part of all rows leaves
at most one row per map task, and no task sees the whole key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from edgelens.schemas import DETAILS_KEY, FIREWALL_KEY, HOURLY_KEY

COUNTERS = ["request_count", "bytes_total", "threats", "unique_visitors"]


def _one_per_key(df: DataFrame, key: list[str | Column], *order: Column) -> DataFrame:
    pick = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(pick)).where("_rank = 1").drop("_rank")


def _any_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def _one_per_whole_key(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """One row per key; a row with a NULL part matches nothing and is a key of its own.

    Such rows get a number, which also spreads them, so that one window serves all. The
    numbers must not change when a task is repeated: the rows should come from files.
    """
    own = F.when(_any_null(key), F.monotonically_increasing_id())
    return _one_per_key(df.withColumn("_own", own), [*key, "_own"], *order).drop("_own")


def write_order(df: DataFrame) -> list[str]:
    """Columns that order rows by when they were written.

    The arrival comes first: run, then landed file. Frames that never went through a
    load have none and fall back to the pull time and their own numbering.
    """
    return [c for c in ("arrival", "collected_at", "ingest_seq") if c in df.columns]


def upsert_hourly(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Last write wins per (bucket, country, method, status).

    A row of the batch replaces a stored one whatever the two say about their time;
    within the batch the later row wins.
    """
    side = F.lit(0), F.lit(1)
    both = stored.withColumn("_side", side[0]).unionByName(
        batch.withColumn("_side", side[1]), allowMissingColumns=True
    )
    return last_write_wins(both, "_side").drop("_side")


def last_write_wins(rows: DataFrame, *first: str) -> DataFrame:
    """Latest row per hourly key, by the columns ``first`` and then the write order."""
    filled = rows.where(F.col("bucket").isNotNull()).withColumns(
        {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in COUNTERS}
    )
    return _one_per_whole_key(filled, HOURLY_KEY, *map(F.desc, (*first, *write_order(rows))))


def first_write_wins(rows: DataFrame) -> DataFrame:
    """Earliest row per event id; events without an id all stay."""
    valid = rows.where(F.col("event_datetime").isNotNull())
    return _one_per_whole_key(valid, FIREWALL_KEY, *map(F.asc, write_order(rows)))


def new_events(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` to insert so that the first write of an event id wins."""
    return unseen_events(stored, first_write_wins(batch))


def unseen_events(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows of ``fresh``, one per event id, whose id is not stored.

    The stored ids are narrowed to those the batch holds before anything is
    joined back: with a small batch that is one broadcast probe over the id
    column and the history is never shuffled. Catalyst checks the size. Rows
    without an id match nothing in either join.
    """
    ids = fresh.select(*FIREWALL_KEY)
    taken = stored.select(*FIREWALL_KEY).join(ids, FIREWALL_KEY, "left_semi")
    return fresh.join(taken, FIREWALL_KEY, "left_anti")


def insert_events(stored: DataFrame, batch: DataFrame) -> DataFrame:
    return stored.unionByName(new_events(stored, batch), allowMissingColumns=True)


def append_details(stored: DataFrame, batch: DataFrame, dedupe: bool = False) -> DataFrame:
    """Plain append; ``dedupe`` keeps the newest pull of each group instead."""
    rows = stored.unionByName(batch)
    if not dedupe:
        return rows
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in DETAILS_KEY]
    return _one_per_key(rows, key, *map(F.desc, write_order(rows)))


def _repair_key() -> list[Column]:
    """Hourly key with NULL read as the default."""
    return [
        F.col("bucket"),
        F.coalesce("country", F.lit("")),
        F.coalesce("http_method", F.lit("")),
        F.coalesce("status_code", F.lit(0)),
    ]


def duplicate_keys(ht: DataFrame) -> DataFrame:
    """Hourly keys that occur more than once when NULL reads as the default."""
    names = HOURLY_KEY
    return (
        ht.groupBy(*(c.alias(n) for c, n in zip(_repair_key(), names)))
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def keep_first(ht: DataFrame) -> DataFrame:
    """Earliest row per hourly key when NULL reads as the default."""
    return _one_per_key(ht, _repair_key(), *map(F.asc, write_order(ht)))


def fill_null_dims(ht: DataFrame) -> DataFrame:
    return ht.withColumns(
        {
            "http_method": F.coalesce("http_method", F.lit("")),
            "status_code": F.coalesce("status_code", F.lit(0)),
            "country": F.coalesce("country", F.lit("Unknown")),
            "content_type": F.coalesce("content_type", F.lit("")),
        }
    )


def null_dims(ht: DataFrame) -> DataFrame:
    """Rows that ``fill_null_dims`` changes."""
    return ht.where(_any_null(["http_method", "status_code", "country", "content_type"]))


def repair(ht: DataFrame) -> DataFrame:
    """Duplicates out, NULLs filled, and the key unique again after the fill.

    Filling can give a row without country the key of an ``Unknown`` row of the same
    hour. Both were measured, so the two add up; the earlier one lends the rest.
    """
    filled = fill_null_dims(keep_first(ht))
    named = [c for c in filled.columns if c not in COUNTERS]
    alike = F.min(F.struct(*write_order(filled), *(F.col(c).alias(f"_{c}") for c in named)))
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint").alias(c) for c in COUNTERS]
    added = filled.groupBy(*HOURLY_KEY).agg(alike.alias("_row"), *sums)
    rest = [F.col(f"_row._{c}").alias(c) for c in named if c not in HOURLY_KEY]
    return added.select(*HOURLY_KEY, *rest, *COUNTERS).select(*ht.columns)

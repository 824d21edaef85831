"""The stored tables: plain Parquet, partitioned by date.

``hourly_traffic`` lies under ``dt=D``; a load rewrites the dates it touches. The
tables that only grow lie under ``dt=D/run_id=R``, so that a load writes its own
partitions. All writes overwrite partitions dynamically, which makes a load that
died half way safe to repeat: what it left behind is written again, not added to.

``loads`` lists the loads that came to their end, with their number; the numbers
order rows by when they were written. One writer at a time, as the load is one
scheduled job; a load that failed is repeated before the next one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types

from edgelens import schemas as S
from edgelens.functions import timetext as T
from edgelens.operators import maintain
from edgelens.session import delete, exists, scratch_path

# Table -> (schema, column that gives the date, partition columns).
TABLES = {
    "hourly_traffic": (S.HOURLY_TRAFFIC, "bucket", ["dt"]),
    "firewall_events": (S.FIREWALL_EVENTS, "event_datetime", ["dt", "run_id"]),
    "request_details": (S.REQUEST_DETAILS, "bucket", ["dt", "run_id"]),
}
# Loads named so are repairs.
REPAIR = "repair-"
LOADS = "run_id string, seq bigint, hourly_dates array<string>"
# Ids of a batch up to which the history is asked for each of them; a Bloom filter in
# every row group answers for those that cannot be there.
PROBE_IDS = 2_000
_IN_THRESHOLD = "spark.sql.parquet.pushdown.inFilterThreshold"


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def exists(self, path: str) -> bool:
        return exists(self.spark, path)

    # --- reading -----------------------------------------------------------

    def loads(self) -> DataFrame:
        path = f"{self.root}/loads"
        if not self.exists(path):
            return self.spark.createDataFrame([], LOADS)
        return self.spark.read.schema(LOADS).parquet(path)

    def read(self, table: str, since: str | None = None, dates: list[str] | None = None) -> DataFrame:
        """Rows of a table with their date ``dt``; only the asked dates are opened."""
        schema, _, parts = TABLES[table]
        full = types.StructType([*schema.fields, *(types.StructField(p, types.StringType()) for p in parts)])
        path = f"{self.root}/{table}"
        if not self.exists(path):
            return self.spark.createDataFrame([], full)
        rows = self.spark.read.schema(full).parquet(path)
        if since is not None:
            rows = rows.where(F.col("dt") >= since)
        if dates is not None:
            rows = rows.where(F.col("dt").isin(dates))
        return rows

    # --- writing -----------------------------------------------------------

    def _write(self, table: str, rows: DataFrame) -> None:
        """Replace the partitions that ``rows`` fall into.

        The rebalance hint sizes the files: small dates share a task, a large date is
        split over several. Events are sorted by id and carry Bloom filters of it.
        """
        schema, column, parts = TABLES[table]
        dated = rows.withColumn("dt", T.partition_date(F.col(column)))
        laid = dated.select(*schema.fieldNames(), *parts).hint("rebalance", "dt")
        writer = laid.write
        if table == "firewall_events":
            key = S.FIREWALL_KEY[0]
            writer = laid.sortWithinPartitions(*parts, key).write.option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(f"{self.root}/{table}")

    def _done(self, run_id: str, seq: int, dates: list[str]) -> None:
        row = self.spark.createDataFrame([(run_id, seq, dates)], LOADS)
        row.coalesce(1).write.mode("append").parquet(f"{self.root}/loads")

    def _next(self, run_id: str) -> int | None:
        """Number for a load; None when it came to its end before."""
        newest, seen = self.loads().agg(F.max("seq"), F.count_if(F.col("run_id") == run_id)).first()
        return None if seen else 0 if newest is None else newest + 1

    @staticmethod
    def _numbered(rows: DataFrame, seq: int) -> DataFrame:
        """Rows with the load's number in front of their arrival."""
        landed = F.col("arrival") if "arrival" in rows.columns else F.lit(None).cast(S.ARRIVAL)
        parts = [landed.getField(f).alias(f) for f in S.ARRIVAL.fieldNames()[1:]]
        return rows.withColumn("arrival", F.struct(F.lit(seq).cast("bigint").alias("run_seq"), *parts))

    def reject(self, run_id: str, rows: DataFrame) -> int:
        """Publish the responses of a load that could not be read; returns their number."""
        path = f"{self.root}/rejected/run_id={run_id}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).count()

    def load(
        self,
        run_id: str,
        hourly: DataFrame | None = None,
        firewall: DataFrame | None = None,
        details: DataFrame | None = None,
    ) -> bool:
        """Load the feeds of one run under the key rule of each table.

        A load that came to its end is skipped, so a repeated call is safe.
        """
        seq = self._next(run_id)
        if seq is None:
            return False
        folder = scratch_path(self.spark, "batch")

        def kept(rows: DataFrame | None, name: str) -> DataFrame | None:
            """A feed as a table of known size; None if it holds nothing."""
            if rows is None:
                return None
            rows.write.parquet(f"{folder}/{name}")
            table = self.spark.read.schema(rows.schema).parquet(f"{folder}/{name}")
            return None if table.isEmpty() else table

        try:
            numbered = [None if f is None else self._numbered(f, seq) for f in (hourly, firewall, details)]
            hourly, events, details = (kept(f, n) for f, n in zip(numbered, ("hourly", "events", "details")))
            dates = []
            if hourly is not None:
                dates = self._upsert(hourly, seq)
            if events is not None:
                self._insert(kept(maintain.first_write_wins(events), "firsts"), run_id)
            if details is not None:
                self._write("request_details", details.withColumn("run_id", F.lit(run_id)))
        finally:
            delete(self.spark, folder)
        done = any(f is not None for f in (hourly, events, details))
        if done:
            self._done(run_id, seq, dates)
        return done

    def _upsert(self, hourly: DataFrame, seq: int) -> list[str]:
        """Last write wins in the dates of a batch; returns them."""
        dates = self._dates(hourly)
        stored = self.read("hourly_traffic", dates=dates).drop("dt")
        # Rows without a whole key match nothing; those of this load, begun before, go.
        begun = (F.col("arrival.run_seq") == seq) & maintain._any_null(S.HOURLY_KEY)
        self._write("hourly_traffic", maintain.upsert_hourly(stored.where(~F.coalesce(begun, F.lit(False))), hourly))
        return dates

    @staticmethod
    def _dates(hourly: DataFrame) -> list[str]:
        """Dates of a batch, a few days."""
        return sorted(r.dt for r in hourly.select(T.partition_date(F.col("bucket")).alias("dt")).distinct().collect())

    def _insert(self, firsts: DataFrame | None, run_id: str) -> None:
        """First write wins over all history."""
        if firsts is None:
            return
        stored = self.read("firewall_events").where(F.col("run_id") != run_id)
        fresh = maintain.unseen_events(self.probed(stored, firsts), firsts)
        self._write("firewall_events", fresh.withColumn("run_id", F.lit(run_id)))

    def probed(self, stored: DataFrame, firsts: DataFrame) -> DataFrame:
        """The stored events a batch may meet: for few ids, asked for by name.

        Then statistics and Bloom filters of each row group tell which to open.
        """
        key = S.FIREWALL_KEY[0]
        named = firsts.select(key).where(F.col(key).isNotNull()).limit(PROBE_IDS + 1).collect()
        if len(named) > PROBE_IDS:
            return stored
        if int(self.spark.conf.get(_IN_THRESHOLD)) < PROBE_IDS:
            self.spark.conf.set(_IN_THRESHOLD, str(PROBE_IDS))
        return stored.where(F.col(key).isin([r[0] for r in named]))

    def repair_hourly(self, run_id: str | None = None) -> bool:
        """Repair the dates that hold NULL dimensions; each repair is a load of its own.

        Only dates written since the last repair are looked at.

        Whole keys are unique in this table, so keys that collide once NULL reads
        as the default always involve a row with a NULL. That makes the search a
        plain filter which Parquet statistics answer for clean files.
        """
        loads = self.loads()
        repaired = F.coalesce(F.max(F.when(F.startswith("run_id", F.lit(REPAIR)), F.col("seq"))), F.lit(-1))
        since = loads.agg(repaired).first()[0]
        touched = loads.where(F.col("seq") > since).select(F.explode("hourly_dates").alias("dt")).distinct().collect()
        nulls = maintain.null_dims(self.read("hourly_traffic", dates=[r.dt for r in touched]))
        bad = [r.dt for r in nulls.select("dt").distinct().collect()]
        if not bad:
            return False
        run_id = run_id or f"{REPAIR}{uuid.uuid4().hex}"
        seq = self._next(run_id)
        if seq is not None:
            self._write("hourly_traffic", maintain.repair(self.read("hourly_traffic", dates=bad).drop("dt")))
            self._done(run_id, seq, bad)
        return True

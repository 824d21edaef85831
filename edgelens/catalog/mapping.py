"""Telemetry tables derived from the generic test tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from edgelens import schemas as S
from edgelens.functions import numeric as N
from edgelens.functions import timetext as T
from edgelens.operators.windows import WINDOW_DAYS
from edgelens.sources import results

# Start of the second pull; response status by event type.
PULL_1, PULL_2 = "2024-01-01T00:00:00Z", "2024-01-16T00:00:00Z"
STATUS = {"error": 500, "view": 200, "click": 302, "signup": 201, "purchase": 202}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_of(spark: SparkSession, sf: str) -> str:
    """Newest event time. A run gets it as a parameter; here the data gives it.

    It is a plain value, so filters made from it reach the Parquet scan.
    """
    return table(spark, sf, "events").agg(F.max("ts").cast("string")).first()[0]


def stamp(spark: SparkSession, sf: str) -> Column:
    """The same as the text that marks loaded rows, worked out only where it is read."""
    return table(spark, sf, "events").agg(T.iso_second(F.max("ts"))).scalar()


def _events(spark: SparkSession, sf: str, since: str | None = None) -> DataFrame:
    events = table(spark, sf, "events")
    if since is not None:
        # A superset of the rolling window that the scan can skip by; the exact
        # filter on bucket text follows.
        day_more = F.make_dt_interval(F.lit(WINDOW_DAYS + 1))
        events = events.where(F.col("ts") >= T.instant(since) - day_more)
    return with_k(events)


def with_k(events: DataFrame) -> DataFrame:
    """The number in the event properties as a column, batch or stream."""
    return events.withColumn("k", F.regexp_extract("props", r'"k"\s*:\s*(\d+)', 1).cast("bigint"))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", "n_name")


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("n_nationkey"), "c_mktsegment"
    )


def places(spark: SparkSession, sf: str) -> DataFrame:
    """Customer to nation; the join strategy is left to the size statistics."""
    return customers(spark, sf).join(nations(spark, sf), "n_nationkey")


def _seq(day: Column, hour: Column, nation: Column) -> Column:
    """Order number of an hourly row: by hour, then nation."""
    hours = F.datediff(day, F.lit("2000-01-01")) * 24 + hour
    return (hours * 100 + nation).cast("bigint")


COUNTERS = ["request_count", "bytes_total", "threats"]


def event_counters() -> list[Column]:
    """Counters one event adds to its hour."""
    errors = F.when(F.col("event_type") == "error", F.floor(F.col("value") / 4)).otherwise(0)
    return [
        F.floor("value").alias("request_count"),
        (F.col("k") * 1000).alias("bytes_total"),
        errors.cast("bigint").alias("threats"),
    ]


def event_sums() -> dict[str, Column]:
    return {c: F.sum(counter) for c, counter in zip(COUNTERS, event_counters())}


def country() -> Column:
    """Nation name; one nation stands for an unknown country."""
    return F.when(F.col("n_name") != "NATION_0", F.col("n_name"))


def hourly_from_events(
    events: DataFrame, users: DataFrame, names: DataFrame, collected_at: Column, visitors: bool = True
) -> DataFrame:
    """Hourly rows of an events frame.

    With distinct visitors, events first combine per hour and user. A user with a
    large part of all events is then at most one row per hour when the join shuffles,
    and distinct visitors become a plain count. Without (``visitors=False``, no such
    column), events join as they are and one map-side combined aggregation is all; a
    busy user is split by the runtime skew join where that join shuffles. Grouping is
    on numbers alone; nation names come last, to the grouped rows.
    """
    sums = [F.sum(c).alias(c) for c in COUNTERS]
    rows = events.select(*T.day_and_hour(F.col("ts")), "user_id", *event_counters())
    counted = []
    if visitors:
        rows = rows.groupBy("day", "hour", "user_id").agg(*sums)
        counted = [F.count(F.lit(1)).alias("unique_visitors")]
    return (
        rows.join(users, "user_id")
        .groupBy("day", "hour", "n_nationkey")
        .agg(*sums, *counted)
        .join(names, "n_nationkey")
        .withColumn("bucket", T.iso_from(F.col("day"), F.col("hour")))
        .select(
            collected_at.alias("collected_at"),
            "bucket",
            country().alias("country"),
            F.lit("").alias("http_method"),
            F.lit(0).alias("status_code"),
            F.lit("").alias("content_type"),
            *COUNTERS,
            *(["unique_visitors"] if visitors else []),
            _seq(F.col("day"), F.col("hour"), F.col("n_nationkey")).alias("ingest_seq"),
        )
    )


def as_hourly_rows(hours: DataFrame) -> DataFrame:
    """Hourly sums with the columns an upsert expects, the write order apart."""
    return hours.select(
        F.lit(PULL_2).alias("collected_at"),
        "bucket",
        "country",
        F.lit("").alias("http_method"),
        F.lit(0).alias("status_code"),
        F.lit("").alias("content_type"),
        *COUNTERS,
        F.lit(0).cast("bigint").alias("unique_visitors"),
    )


def hourly_traffic(
    spark: SparkSession, sf: str, since: str | None = None, visitors: bool = True
) -> DataFrame:
    """The hourly table; with ``since``, at least the rolling window before it."""
    users, names = customers(spark, sf), nations(spark, sf)
    collected_at = stamp(spark, sf) if since is None else T.iso_second(T.instant(since))
    return hourly_from_events(_events(spark, sf, since), users, names, collected_at, visitors)


def hourly_sums(spark: SparkSession, sf: str, since: str | None = None) -> DataFrame:
    """The hourly table without its distinct visitors, for all that never reads them."""
    return hourly_traffic(spark, sf, since, visitors=False)


def hourly_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping pulls: even events early on, all events from the 14th later."""
    events, users, names = _events(spark, sf), customers(spark, sf), nations(spark, sf)
    start = datetime(2024, 1, 14)
    first = events.where(F.col("event_id") % 2 == 0)
    second = events.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return (
        hourly_from_events(first, users, names, F.lit(PULL_2)),
        hourly_from_events(second, users, names, F.lit("2024-01-31T00:00:00Z")),
    )


def hourly_from_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """A larger hourly table: shipments per day and supplier nation.

    Lines join first here: without distinct visitors, one aggregation after the
    join is all there is. A supplier with a large part of all lines is split by
    the runtime skew join where the join shuffles.
    """
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey")
    )
    returned = F.when(F.col("l_returnflag") == "R", F.floor(F.col("l_quantity") / 8)).otherwise(0)
    return (
        table(spark, sf, "lineitem")
        .join(suppliers, "l_suppkey")
        .groupBy(F.col("l_shipdate").alias("day"), "n_nationkey")
        .agg(
            F.sum(F.col("l_quantity").cast("bigint")).alias("request_count"),
            F.sum(F.floor(F.col("l_extendedprice") * 100)).alias("bytes_total"),
            F.sum(returned).alias("threats"),
        )
        .join(nations(spark, sf), "n_nationkey")
        .select(
            T.iso_second(F.col("day")).alias("bucket"),
            F.col("n_name").alias("country"),
            F.lit("").alias("http_method"),
            F.lit(0).alias("status_code"),
            *COUNTERS,
        )
    )


def dirty_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly rows plus a later copy of the 03:00 hours with NULL method and status.

    The copies are made by fanning out rows in place, so the table is built once.
    """
    ht = hourly_traffic(spark, sf)
    copy = F.col("copy") == 1
    return (
        ht.withColumn(
            "copy",
            F.explode(
                F.when(F.col("bucket").endswith("T03:00:00Z"), F.array(F.lit(0), F.lit(1))).otherwise(
                    F.array(F.lit(0))
                )
            ),
        )
        .withColumn("http_method", F.when(~copy, F.col("http_method")))
        .withColumn("status_code", F.when(~copy, F.col("status_code")))
        .withColumn("ingest_seq", F.col("ingest_seq") + F.col("copy") * 100_000_000)
        .drop("copy")
    )


def _method(user: Column) -> Column:
    names = F.array(*(F.lit(m) for m in ("GET", "POST", "HEAD", "PUT")))
    return F.get(names, (user % 4).cast("int"))


def firewall_rows(events: DataFrame, *more: Column) -> DataFrame:
    """Event rows from an events frame, batch or stream."""
    user, k = F.col("user_id"), F.col("k").cast("string")

    def numbered(prefix: str, n: Column) -> Column:
        return F.concat(F.lit(prefix), n.cast("string"))

    high, low = F.floor(user / 256), user % 256
    return events.select(
        T.iso_second(F.col("ts")).alias("event_datetime"),
        F.col("event_type").alias("action"),
        F.concat(numbered("10.0.", high), numbered(".", low)).alias("client_ip"),
        numbered("host-", user % 3).alias("host"),
        _method(user).alias("http_method"),
        numbered("/k/", k).alias("request_path"),
        numbered("ua-", user % 40).alias("user_agent"),
        numbered("r", F.col("k") % 10).alias("rule_id"),
        F.when(F.col("event_id") % 100 == 0, "")
        .otherwise(numbered("ray-", F.col("event_id")))
        .alias("ray_name"),
        F.col("event_id").alias("ingest_seq"),
        *more,
    )


def firewall_events(
    spark: SparkSession, sf: str, since: str | None = None, placed: bool = True
) -> DataFrame:
    """One row per event; with ``since``, at least the rolling window before it.

    ``placed=False`` leaves out country and source, and with them the join: each
    event has exactly one customer, so the rows are the same.
    """
    events = _events(spark, sf, since)
    more = [stamp(spark, sf).alias("collected_at")]
    if placed:
        events = events.join(places(spark, sf), "user_id")
        more += [F.col("n_name").alias("country"), F.col("c_mktsegment").alias("source")]
    return firewall_rows(events, *more)


def event_counts(spark: SparkSession, sf: str, since: str) -> DataFrame:
    """Country and source with the number ``n`` of events of the rolling window.

    Events count per user before they join, so a busy user is one row there.
    """
    second = T.iso_second(F.col("ts"))
    recent = _events(spark, sf, since).where(second >= T.cutoff(since, days=WINDOW_DAYS))
    per_user = recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return per_user.join(places(spark, sf), "user_id").select(
        F.col("n_name").alias("country"), F.col("c_mktsegment").alias("source"), "n"
    )


def separated(ht: DataFrame) -> DataFrame:
    """Hourly rows moved into six tight groups that any correct clustering finds."""
    g = F.col("ingest_seq") % 6
    return ht.where(F.col("country").isNotNull()).withColumns(
        {
            "country": F.concat(F.lit("G"), g.cast("string")),
            "request_count": (g + 1) * 100_000 + F.col("request_count") % 7,
            "bytes_total": (g + 1) * 1_000_000,
            "threats": g * g * 3000,
        }
    )


def spiked(hours: DataFrame) -> DataFrame:
    """Hourly totals with the two busiest hours multiplied, so that they stand out."""
    busiest = hours.orderBy(F.desc("total_requests"), "bucket").limit(2)
    marks = busiest.select("bucket", F.lit(1000).alias("times"))
    times = F.coalesce("times", F.lit(1))
    return hours.join(marks, "bucket", "left").select(
        "bucket",
        *((F.col(c) * times).alias(c) for c in ("total_requests", "total_bytes", "total_threats")),
        "unique_countries",
    )


def firewall_batches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Events before the 16th, and events from the 14th on marked ``late``."""
    fe = firewall_events(spark, sf)
    first = fe.where(F.col("event_datetime") < PULL_2).withColumn("collected_at", F.lit(PULL_2))
    second = (
        fe.where(F.col("event_datetime") >= "2024-01-14T00:00:00Z")
        .withColumn("collected_at", F.lit("2024-01-31T00:00:00Z"))
        .withColumn("action", F.lit("late"))
    )
    return first, second


def request_details(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped counts of two pulls; the bucket is the start of the pull."""
    events = _events(spark, sf)
    cases = F.coalesce(*(F.when(F.col("event_type") == t, s) for t, s in STATUS.items()))
    per_user = (
        events.select(
            "user_id",
            F.when(T.iso_second(F.col("ts")) < PULL_2, PULL_1).otherwise(PULL_2).alias("bucket"),
            cases.cast("int").alias("status_code"),
            F.concat(F.lit("/k/"), F.floor(F.col("k") / 20).cast("string")).alias("path"),
        )
        .groupBy("user_id", "bucket", "status_code", "path")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        per_user.join(customers(spark, sf), "user_id")
        .groupBy(
            "bucket", "n_nationkey", _method(F.col("user_id")).alias("http_method"), "status_code", "path"
        )
        .agg(F.sum("n").alias("request_count"))
        .join(nations(spark, sf), "n_nationkey")
        .select(
            F.lit(PULL_2).alias("collected_at"),
            "bucket",
            F.col("n_name").alias("country"),
            "http_method",
            "status_code",
            "path",
            "request_count",
            F.lit(0).cast("bigint").alias("ingest_seq"),
        )
    )


def clustered(ht: DataFrame) -> DataFrame:
    """Fixed cluster of each hourly row, in place of a fitted model."""
    return ht.where(F.col("country").isNotNull()).withColumn(
        "cluster",
        F.when(F.col("threats") * 5 > F.col("request_count"), 5)
        .otherwise(F.least(F.lit(4), F.call_function("div", F.col("request_count"), F.lit(45))))
        .cast("int"),
    )


# --- feed responses --------------------------------------------------------


def _response(feed: str, entry: Column) -> Column:
    """One response document around one feed entry, as JSON text."""
    zone = F.struct(F.array(entry).alias(feed))
    viewer = F.struct(F.array(zone).alias("zones"))
    return F.to_json(F.struct(F.struct(viewer.alias("viewer")).alias("data"))).alias("payload")


def hourly_payload(spark: SparkSession, sf: str) -> DataFrame:
    """A response per hour; the 05:00 hours come without countries.

    The list of an hour holds one entry per country of the hourly table.
    """
    country = F.struct(
        F.col("country").alias("clientCountryName"),
        F.col("request_count").alias("requests"),
        "threats",
        F.col("bytes_total").alias("bytes"),
    )
    hours = hourly_traffic(spark, sf).groupBy("bucket").agg(
        F.sum("request_count").alias("requests"),
        F.sum("bytes_total").alias("bytes"),
        F.sum("threats").alias("threats"),
        F.sum("unique_visitors").alias("uniques"),
        F.collect_list(country).alias("countries"),
    )
    emptied = F.filter("countries", lambda c: ~F.col("bucket").endswith("T05:00:00Z"))
    entry = F.struct(
        F.struct(F.col("bucket").alias("datetime")).alias("dimensions"),
        F.struct("requests", "bytes", "threats", emptied.alias("countryMap")).alias("sum"),
        F.struct("uniques").alias("uniq"),
    )
    return hours.select("bucket", _response(S.HOURLY_FEED, entry))


def firewall_payload(spark: SparkSession, sf: str) -> DataFrame:
    """A response per event; every fiftieth event lacks its user agent."""
    return firewall_responses(firewall_events(spark, sf))


def firewall_responses(fe: DataFrame) -> DataFrame:
    agent = F.when(F.col("ingest_seq") % 50 != 0, F.col("user_agent"))
    entry = F.struct(
        "action",
        F.col("client_ip").alias("clientIP"),
        F.col("country").alias("clientCountryName"),
        F.col("host").alias("clientRequestHTTPHost"),
        F.col("http_method").alias("clientRequestHTTPMethodName"),
        F.col("request_path").alias("clientRequestPath"),
        F.col("event_datetime").alias("datetime"),
        agent.alias("userAgent"),
        F.col("rule_id").alias("ruleId"),
        "source",
        F.col("ray_name").alias("rayName"),
    )
    return fe.select(_response(S.FIREWALL_FEED, entry))


def details_payload(spark: SparkSession, sf: str) -> DataFrame:
    """A response per group with the start of its pull; path 4 has no status."""
    entry = F.struct(
        F.col("request_count").alias("count"),
        F.struct(
            F.col("country").alias("clientCountryName"),
            F.col("http_method").alias("clientRequestHTTPMethodName"),
            F.when(F.col("path") != "/k/4", F.col("status_code")).alias("edgeResponseStatus"),
            F.col("path").alias("clientRequestPath"),
        ).alias("dimensions"),
    )
    start = F.concat(F.substring("bucket", 1, 13), F.lit(":17:42Z")).alias("window_start")
    return request_details(spark, sf).select(start, _response(S.DETAILS_FEED, entry))


# --- result log ------------------------------------------------------------


def result_log(spark: SparkSession, sf: str) -> DataFrame:
    """Three runs of headline documents per model, six hours apart, each over the
    data up to its run time."""
    now = T.instant(as_of(spark, sf))
    steps = [F.make_dt_interval(F.lit(0), F.lit(h)) for h in (12, 6, 0)]
    runs = F.array(
        *(F.struct(F.lit(i).alias("seq"), T.iso_second(now - s).alias("run_at")) for i, s in enumerate(steps))
    )
    placed = F.col("country").isNotNull()
    traffic = (
        hourly_traffic(spark, sf)
        .withColumn("run", F.explode(runs))
        .where(F.col("bucket") <= F.col("run.run_at"))
        .groupBy("run")
        .agg(
            F.count(F.lit(1)).alias("data_rows"),
            F.min("bucket").alias("earliest_data"),
            F.max("bucket").alias("latest_data"),
            F.sum("request_count").alias("total_requests"),
            F.sum("bytes_total").alias("total_bytes"),
            F.sum("threats").alias("total_threats"),
            F.countDistinct("country").alias("unique_countries"),
            F.countDistinct("bucket").alias("buckets"),
            F.count_if(placed).alias("placed_rows"),
            F.sum(F.when(placed, F.col("request_count"))).alias("placed_requests"),
        )
    )
    actions = (
        firewall_events(spark, sf, placed=False)
        .withColumn("run", F.explode(runs))
        .where(F.col("event_datetime") <= F.col("run.run_at"))
        .groupBy("run", "action")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("run")
        .agg(
            F.sum("n").alias("total_events"),
            F.transform(
                F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("down"), "action", "n"))),
                lambda a: F.struct(a["action"], a["n"]),
            ).alias("ordered"),
        )
    )
    c = F.col
    documents = {
        "summary": {
            name: c(name)
            for name in S.SUMMARY_DOC.fieldNames()
            if name != "firewall_events"
        }
        | {"firewall_events": c("total_events")},
        "geo_analysis": {
            "total_countries": c("unique_countries"),
            "total_requests": c("placed_requests"),
        },
        "firewall_analysis": {
            "total_events": c("total_events"),
            "by_action": F.map_from_entries("ordered"),
        },
        "kmeans_traffic": {
            "n_clusters": N.cluster_count(c("placed_rows")),
            "total_rows_analyzed": c("placed_rows"),
        },
        "isolation_forest": {
            "total_buckets_analyzed": c("buckets"),
            "contamination_rate": N.contamination(c("buckets")),
        },
    }
    rows = F.array(
        *(
            F.struct(
                F.lit(model).alias("model_name"),
                F.lit(S.RESULTS[model][0]).alias("result_type"),
                results.document_json(model, fields).alias("result_json"),
            )
            for model, fields in documents.items()
        )
    )
    return (
        traffic.join(actions, "run")
        .select("run", F.explode(rows).alias("doc"))
        .select("run.run_at", "doc.*", c("run.seq").cast("bigint").alias("ingest_seq"))
    )

"""Full runs: collect, analyze, present, and the three in sequence."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from edgelens import schemas as S
from edgelens.functions import timetext as T
from edgelens.operators import rollups
from edgelens.operators.windows import MIN_ROWS, WINDOW_DAYS, cap_rows, open_interval, rolling_window
from edgelens.plans import documents, series
from edgelens.session import checkpoint, written
from edgelens.sources import feeds, results
from edgelens.sources.store import Store
from edgelens.streaming import ingest


FEED_FOLDERS = {S.HOURLY_FEED: "hourly", S.FIREWALL_FEED: "firewall", S.DETAILS_FEED: "details"}


def _text(spark: SparkSession, column: Column) -> str:
    return spark.range(1).select(column).first()[0]


def collect(
    store: Store,
    landing: str,
    as_of: datetime | str,
    run_id: str,
    hours_back: int | None = None,
    details_hours: int = 25,
    cap: int | None = None,
    strict: bool = False,
) -> bool:
    """Flatten the landed responses of one pull and load them, all or nothing.

    Everything landed is loaded, unless ``hours_back`` asks for the hours strictly
    before ``as_of`` (events reach back a day at most) or ``cap`` for the first
    rows of each feed: the oldest hours and events, the largest request groups.
    Responses that cannot be read are published under ``rejected``; with ``strict``
    they stop the run before anything is loaded.
    """
    store.repair_hourly()

    def landed(feed: str) -> DataFrame | None:
        path = f"{landing}/{feed}"
        return feeds.read_landing(store.spark, path) if store.exists(path) else None

    responses = {name: landed(folder) for name, folder in FEED_FOLDERS.items()}
    unread = [feeds.rejected(rows, name) for name, rows in responses.items() if rows is not None]
    if unread and (n := store.reject(run_id, reduce(DataFrame.unionByName, unread))) and strict:
        raise ValueError(f"{n} responses of run {run_id} cannot be read, see {store.root}/rejected")

    def recent(rows: DataFrame, time: str, longest: int | None = None) -> DataFrame:
        if hours_back is not None:
            rows = open_interval(rows, time, as_of, hours_back, longest)
        return cap_rows(rows, cap, F.asc(time), F.asc("ingest_seq"))

    hourly, firewall, details = responses.values()
    if hourly is not None:
        hourly = recent(feeds.flatten_hourly(hourly, as_of), "bucket")
    if firewall is not None:
        firewall = feeds.flatten_firewall(firewall, as_of)
        firewall = recent(firewall, "event_datetime", feeds.FIREWALL_MAX_HOURS)
    if details is not None:
        start = T.cutoff(as_of, hours=min(details_hours, feeds.DETAILS_MAX_HOURS))
        details = feeds.flatten_details(details, as_of, start)
        details = cap_rows(details, cap, F.desc("request_count"), F.asc("ingest_seq"))
    return store.load(run_id, hourly=hourly, firewall=firewall, details=details)


def analyze(
    store: Store, log_path: str, as_of: datetime | str, min_rows: int = MIN_ROWS, seq: int | None = None
) -> list[str]:
    """Run the five analyses and append one document each; returns what was written.

    The documents get the next number of the log, or ``seq``; then a document that the
    log holds under that number is not made again.

    The analyses are independent jobs and are submitted together; each appends on
    its own, so one that fails does not take the others along.
    """
    spark = store.spark
    run_at = _text(spark, T.cutoff(as_of))
    since = _text(spark, T.date_of_iso(T.cutoff(as_of, days=WINDOW_DAYS)))
    store.repair_hourly()
    there = set()
    if seq is None:
        seq = results.next_seq(spark, log_path)
    else:
        numbered = results.read_log(spark, log_path).where(F.col("ingest_seq") == seq)
        there = {r.model_name for r in numbered.select("model_name").collect()}
    ht, fe = store.read("hourly_traffic"), store.read("firewall_events")
    recent_ht = store.read("hourly_traffic", since=since)
    recent_fe = store.read("firewall_events", since=since)
    builders = {
        "kmeans_traffic": lambda: documents.persona(ht, min_rows),
        "isolation_forest": lambda: documents.anomaly(recent_ht, as_of, min_rows),
        "geo_analysis": lambda: documents.geo(ht),
        "firewall_analysis": lambda: documents.firewall(recent_fe, as_of),
        "summary": lambda: documents.summary(ht, fe),
    }

    def build(model: str) -> DataFrame | None:
        document = builders[model]()
        return None if document is None else checkpoint(results.to_log(document, model, run_at, seq))

    with ThreadPoolExecutor(len(builders)) as pool:
        pending = {m: pool.submit(inheritable_thread_target(spark)(build), m) for m in builders if m not in there}
    written, failed = [], []
    for model, future in pending.items():
        if future.exception() is not None:
            failed.append((model, future.exception()))
            continue
        rows = future.result()
        if rows is not None and not rows.isEmpty():
            results.append(rows, log_path)
            written.append(model)
    if failed:
        names = ", ".join(m for m, _ in failed)
        raise RuntimeError(f"analyses failed: {names}") from failed[0][1]
    return written


def present(store: Store, log_path: str, as_of: datetime | str) -> dict[str, DataFrame]:
    """The presentation tables, from the newest documents and the live series."""
    spark = store.spark
    since = _text(spark, T.date_of_iso(T.cutoff(as_of, days=WINDOW_DAYS)))
    log = results.read_log(spark, log_path)
    latest = results.latest(log)

    def doc(model: str) -> DataFrame:
        return results.parsed_or_default(latest, model)

    recent = rolling_window(store.read("hourly_traffic", since=since), "bucket", as_of)
    flagged = doc("isolation_forest").select(F.inline("anomalies"))
    countries = doc("geo_analysis").select(F.inline("countries")).withColumnRenamed(
        "threat_ratio", "threat_pct"
    )
    profiles = (
        doc("kmeans_traffic")
        .select(F.posexplode("profiles").alias("rank", "p"))
        .select("rank", "p.*")
        .withColumn(
            "top_countries",
            F.transform(
                F.map_entries("top_countries"),
                lambda e: F.struct(e["key"].alias("country"), e["value"].alias("count")),
            ),
        )
    )
    return {
        "header_cards": series.header_cards(doc("summary")),
        "traffic_bars": series.traffic_bars(rollups.request_series(recent), flagged),
        "top_countries": series.top_countries(countries),
        "threat_bars": series.threat_bars(countries),
        "persona_cards": series.persona_cards(profiles),
        "persona_bubbles": series.persona_bubbles(profiles),
        "anomaly_table": series.anomaly_table(flagged).orderBy("bucket"),
        "action_shares": series.action_shares(doc("firewall_analysis")),
        "persona_header": series.persona_header(doc("kmeans_traffic")),
        "anomaly_header": series.anomaly_header(doc("isolation_forest")),
        "results": results.with_defaults(spark, log),
    }


def scheduled_run(
    store: Store, landing: str, places: str, log_path: str, out: str, as_of: datetime | str, run_id: str
) -> list[str]:
    """One incremental run: load what landed since the last, analyze, publish.

    ``places`` is the folder in which each feed's stream keeps how far it has read.
    """
    start = T.cutoff(as_of, hours=feeds.DETAILS_MAX_HOURS)
    store.repair_hourly()
    present_feeds = {name for name in FEED_FOLDERS.values() if store.exists(f"{landing}/{name}")}
    ingest.load_landed(store, landing, places, as_of, start, run_id, present_feeds)
    analyze(store, log_path, as_of)
    tables = present(store, log_path, as_of)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    return sorted(tables)


def retrain_on_arrival(store: Store, landing: str, place: str, log_path: str, as_of: datetime | str) -> None:
    """One trigger: load what landed in any feed since the last, then retrain, batch by batch.

    ``place`` keeps how far the stream has read. The feeds of a batch are loaded together.
    Loads and documents carry the number of their batch, so a batch that is replayed
    after a loss makes neither again.
    """
    spark = store.spark
    start = T.cutoff(as_of, hours=feeds.DETAILS_MAX_HOURS)

    def write(batch: DataFrame, number: int) -> None:
        landed = written(batch, "landed")
        folder = F.element_at(F.split("arrival.landed_file", "/"), -2)
        rows = {name: landed.where(folder == name) for name in FEED_FOLDERS.values()}
        run_id = f"batch-{number:08d}"
        unread = [feeds.rejected(rows[name], feed) for feed, name in FEED_FOLDERS.items()]
        store.reject(run_id, reduce(DataFrame.unionByName, unread))
        store.repair_hourly()
        store.load(
            run_id,
            hourly=feeds.flatten_hourly(rows["hourly"], as_of),
            firewall=feeds.flatten_firewall(rows["firewall"], as_of),
            details=feeds.flatten_details(rows["details"], as_of, start),
        )
        analyze(store, log_path, as_of, seq=number)

    ingest.run_available(feeds.stream_landing(spark, f"{landing}/*"), place, write)


def full_run(
    store: Store, landing: str, log_path: str, out: str, as_of: datetime | str, run_id: str
) -> list[str]:
    """Collect, analyze, then write every presentation table."""
    collect(store, landing, as_of, run_id)
    analyze(store, log_path, as_of)
    tables = present(store, log_path, as_of)
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    return sorted(tables)

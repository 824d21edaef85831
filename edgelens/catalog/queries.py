"""One entry per query: (session, data folder) to a frame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from edgelens import schemas as S
from edgelens.catalog import mapping as M
from edgelens.functions import numeric as N
from edgelens.functions import timetext as T
from edgelens.operators import breakdown, features, forest, maintain, personas, rollups, windows
from edgelens.plans import documents, jobs, series
from edgelens.session import checkpoint, scratch_path, written
from edgelens.sources import feeds, results
from edgelens.sources.store import Store
from edgelens.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HOURLY = ["bucket", "country", "http_method", "status_code", "content_type"]
COUNTERS = ["request_count", "bytes_total", "threats", "unique_visitors"]
NEVER = "2030-01-01T00:00:00Z"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _recent_hourly(spark: SparkSession, sf: str, visitors: bool = False) -> DataFrame:
    now = M.as_of(spark, sf)
    return windows.rolling_window(M.hourly_traffic(spark, sf, now, visitors), "bucket", now)


def _recent_firewall(spark: SparkSession, sf: str, placed: bool = True) -> DataFrame:
    now = M.as_of(spark, sf)
    return windows.rolling_window(M.firewall_events(spark, sf, now, placed), "event_datetime", now)


def _clustered(spark: SparkSession, sf: str) -> DataFrame:
    return M.clustered(M.hourly_sums(spark, sf))


# --- feeds -----------------------------------------------------------------


@query
def src_hourly_flatten(spark, sf):
    return feeds.flatten_hourly(M.hourly_payload(spark, sf), M.as_of(spark, sf)).select(
        *HOURLY, *COUNTERS
    )


@query
def src_hourly_fallback(spark, sf):
    rows = feeds.flatten_hourly(M.hourly_payload(spark, sf), M.as_of(spark, sf))
    return rows.where(F.col("country") == "Unknown").select(*HOURLY, *COUNTERS)


@query
def src_firewall_flatten(spark, sf):
    rows = feeds.flatten_firewall(M.firewall_payload(spark, sf), M.as_of(spark, sf))
    return rows.drop("ingest_seq")


def _broken_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Responses by hour of day, those of some hours replaced by broken ones.

    Hour 10 comes as a document over four lines, which land as four rows, one of
    them a document without feed. Hour 11 has a broken number.
    """
    broken = {
        "06": '{"data":{"viewer":{"zones":[]}}}',
        "07": '{"data":null}',
        "08": "no json",
        "09": '{"data":{"viewer":{"zones":[{}]}}}',
        "10": '{\n"data":\n{"viewer":null}\n}',
    }
    hour = F.substring("bucket", 12, 2)
    wrong = F.regexp_replace("payload", r'"bytes":(\d+)', r'"bytes":$1.5')
    text = F.coalesce(
        *(F.when(hour == h, doc) for h, doc in broken.items()), F.when(hour == "11", wrong), F.col("payload")
    )
    return M.hourly_payload(spark, sf).select(hour.alias("hour"), F.explode(F.split(text, "\n")).alias("payload"))


@query
def src_rejected(spark, sf):
    """Responses that cannot be read, per hour of day and reason, and what is loaded."""
    landed = checkpoint(_broken_hours(spark, sf))
    bad = feeds.rejected(landed, S.HOURLY_FEED).groupBy("hour", "reason").agg(F.count(F.lit(1)).alias("responses"))
    rows = feeds.flatten_hourly(landed, M.PULL_2).groupBy(F.substring("bucket", 12, 2).alias("hour"))
    loaded = rows.agg(F.lit("loaded").alias("reason"), F.countDistinct("bucket").alias("responses"))
    return bad.unionByName(loaded)


@query
def src_details_flatten(spark, sf):
    landed = M.details_payload(spark, sf)
    rows = feeds.flatten_details(landed, M.as_of(spark, sf), F.col("window_start"))
    return rows.drop("ingest_seq")


@query
def src_empty_payload(spark, sf):
    """Rows per hour of day; the hours 06 to 09 come in broken responses."""
    broken = {
        "06": '{"data":{"viewer":{"zones":[]}}}',
        "07": '{"data":null}',
        "08": "no json",
        "09": '{"data":{"viewer":{"zones":[{}]}}}',
    }
    hour = F.substring("bucket", 12, 2)
    text = F.coalesce(*(F.when(hour == h, doc) for h, doc in broken.items()), F.col("payload"))
    landed = M.hourly_payload(spark, sf).select(hour.alias("hour"), text.alias("payload"))
    landed = checkpoint(landed)
    per_hour = feeds.flatten_hourly(landed, M.as_of(spark, sf)).groupBy(hour.alias("hour")).agg(
        F.count(F.lit(1)).alias("n")
    )
    payloads = landed.groupBy("hour").agg(F.count(F.lit(1)).alias("payloads"))
    return payloads.join(per_hour, "hour", "left").select(
        "hour", "payloads", F.coalesce("n", F.lit(0)).cast("bigint").alias("flattened")
    )


# --- result log ------------------------------------------------------------

HEADLINES = {
    "summary": "data_rows",
    "geo_analysis": "total_countries",
    "firewall_analysis": "total_events",
    "kmeans_traffic": "total_rows_analyzed",
    "isolation_forest": "total_buckets_analyzed",
}


def _headline() -> Column:
    """The leading number of a document of any model."""
    doc = F.from_json("result_json", ", ".join(f"{f} bigint" for f in HEADLINES.values()))
    return F.coalesce(
        *(F.when(F.col("model_name") == m, doc.getField(f)) for m, f in HEADLINES.items()), F.lit(0)
    ).cast("bigint").alias("headline")


@query
def result_log_append(spark, sf):
    path = scratch_path(spark, "log")
    log = checkpoint(M.result_log(spark, sf))
    for run in range(3):
        results.append(log.where(F.col("ingest_seq") == run), path)
    return results.read_log(spark, path).drop("result_json")


@query
def latest_result_per_model(spark, sf):
    """The newest run's documents; an earlier run repeats its time."""
    log = M.result_log(spark, sf)
    again = F.when(F.col("ingest_seq") == 1, log.agg(F.max("run_at")).scalar()).otherwise(F.col("run_at"))
    newest = results.latest(log.withColumn("run_at", again))
    return newest.select("model_name", "run_at", "result_type", _headline())


@query
def scalar_json_roundtrip(spark, sf):
    """Documents decoded, read by field and key, and encoded again."""
    log = M.result_log(spark, sf)
    again = F.coalesce(
        *(
            F.when(
                F.col("model_name") == m,
                F.to_json(F.from_json("result_json", schema), {"ignoreNullFields": "false"}),
            )
            for m, (_, schema) in S.RESULTS.items()
        )
    )
    doc = F.from_json("result_json", "by_action map<string, bigint>, inertia double")
    names = F.coalesce(F.map_keys(doc["by_action"]), F.array().cast("array<string>"))
    return log.select(
        "run_at",
        "model_name",
        _headline(),
        F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("first_action"),
        F.size(names).cast("bigint").alias("n_actions"),
        F.coalesce(doc["inertia"], F.lit(0.0)).alias("inertia"),
        (again == F.col("result_json")).alias("same_text"),
    )


@query
def view_missing_defaults(spark, sf):
    """Models of a log that lacks three of them, and of a log that is not there."""
    partial = M.result_log(spark, sf).where(F.col("model_name").isin("summary", "firewall_analysis"))
    absent = results.read_log(spark, scratch_path(spark, "no-log"))
    lists = F.from_json("result_json", "countries array<string>, profiles array<string>, anomalies array<string>")
    empty = F.greatest(*(F.coalesce(F.size(lists[c]), F.lit(0)) for c in ("countries", "profiles", "anomalies")))

    def shown(name: str, log: DataFrame) -> DataFrame:
        return results.with_defaults(spark, log).select(
            F.lit(name).alias("log"), "model_name", "has_result", "run_at", _headline(), empty.cast("bigint").alias("listed")
        )

    cards = series.header_cards(results.parsed_or_default(results.latest(absent), "summary"))
    zeros = cards.select(
        F.lit("absent").alias("log"), F.lit("cards").alias("model_name"), F.lit(False).alias("has_result"),
        F.col("data_through").alias("run_at"), F.col("total_requests").cast("bigint").alias("headline"),
        F.col("unique_countries").cast("bigint").alias("listed"),
    )
    return shown("partial", partial).unionByName(shown("absent", absent)).unionByName(zeros)


# --- filters and caps ------------------------------------------------------


@query
def filter_open_interval(spark, sf):
    now = M.as_of(spark, sf)
    fe = M.firewall_events(spark, sf, now, placed=False)
    kept = windows.open_interval(
        fe, "event_datetime", now, hours_back=25, cap=feeds.FIREWALL_MAX_HOURS
    )
    return kept.select("event_datetime", "ray_name", "action", "client_ip")


@query
def filter_rolling_7d(spark, sf):
    return _recent_hourly(spark, sf, visitors=True).select("bucket", "country", *COUNTERS)


@query
def cap_top_n(spark, sf):
    """The thousand oldest events and the thousand largest request groups."""
    events = windows.cap_rows(
        M.firewall_events(spark, sf, placed=False), 1000, F.asc("event_datetime"), F.asc("ingest_seq")
    ).select(
        F.lit("firewall").alias("feed"),
        F.col("event_datetime").alias("sorted_by"),
        F.col("ingest_seq").cast("string").alias("item"),
    )
    key = ["bucket", "country", "http_method", "status_code", "path"]
    groups = windows.cap_rows(
        M.request_details(spark, sf), 1000, F.desc("request_count"), *(F.asc(c) for c in key)
    ).select(
        F.lit("details").alias("feed"),
        F.col("request_count").cast("string").alias("sorted_by"),
        F.concat_ws("|", *(F.col(c).cast("string") for c in key)).alias("item"),
    )
    return events.unionByName(groups)


@query
def gate_min_rows(spark, sf):
    hours = checkpoint(rollups.by_bucket(_recent_hourly(spark, sf)))
    outcome = None
    for rows in (windows.MIN_ROWS, 169, 100_000):
        passed = windows.at_least(hours, rows).agg(
            F.lit(rows).cast("bigint").alias("min_rows"), F.count(F.lit(1)).alias("rows_out")
        )
        outcome = passed if outcome is None else outcome.unionByName(passed)
    return outcome


@query
def empty_window_results(spark, sf):
    """What each analysis gives when its window holds nothing."""
    ht = windows.rolling_window(M.hourly_sums(spark, sf), "bucket", NEVER)
    fe = M.firewall_events(spark, sf)

    def shape(name: str, document: DataFrame, total: str) -> DataFrame:
        return document.agg(
            F.lit(name).alias("result"),
            F.count(F.lit(1)).alias("result_rows"),
            F.coalesce(F.sum(total), F.lit(0)).cast("bigint").alias("total"),
        )

    none = windows.rolling_window(fe, "event_datetime", NEVER)
    return (
        shape("summary", documents.summary(ht, none), "data_rows")
        .unionByName(shape("firewall_analysis", documents.firewall(fe, NEVER), "total_events"))
        .unionByName(shape("geo_analysis", documents.geo(ht), "total_requests"))
        .unionByName(shape("hours", rollups.by_bucket(ht), "total_requests"))
    )


# --- rollups ---------------------------------------------------------------


@query
def rollup_by_bucket(spark, sf):
    return rollups.by_bucket(M.hourly_sums(spark, sf))


@query
def geo_country_distribution(spark, sf):
    return rollups.country_distribution(M.hourly_sums(spark, sf))


@query
def series_country_top10(spark, sf):
    return series.top_countries(rollups.country_distribution(M.hourly_sums(spark, sf)))


@query
def series_threat_top8(spark, sf):
    return series.threat_bars(rollups.country_distribution(M.hourly_sums(spark, sf)))


@query
def series_traffic(spark, sf):
    return rollups.request_series(_recent_hourly(spark, sf))


@query
def series_mark_join(spark, sf):
    """Bars with the two busiest hours marked."""
    hours = rollups.request_series(_recent_hourly(spark, sf))
    marked = hours.orderBy(F.desc("total_requests"), "bucket").limit(2)
    return series.traffic_bars(hours, marked)


@query
def summary_stats(spark, sf):
    return rollups.summary(
        M.hourly_sums(spark, sf), M.firewall_events(spark, sf, placed=False)
    )


@query
def view_header_cards(spark, sf):
    return series.header_cards(summary_stats(spark, sf))


@query
def request_quantiles(spark, sf):
    rows = features.cluster_input(M.hourly_sums(spark, sf))
    return rollups.exact_quantiles(rows, "request_count", personas.NAMING_QUANTILES)


@query
def request_quantiles_sketched(spark, sf):
    """Quantiles from merged sketches of the dates, held against exact ranks: a sketched
    quantile must have its share of all rows, give or take one percent, at or below it."""
    rows = written(features.cluster_input(M.hourly_sums(spark, sf)), "rows")
    sketches = written(
        rollups.quantile_sketches(rows, "request_count", T.date_of_iso(F.col("bucket"))), "sketches"
    )
    found = rollups.sketched_quantiles(sketches, personas.NAMING_QUANTILES)
    names = [c for c in found.columns if c != "n"]
    listed = F.array(
        *(F.struct(F.lit(p).alias("share"), F.col(c).alias("value")) for p, c in zip(personas.NAMING_QUANTILES, names))
    )
    asked = found.select("n", F.explode(listed).alias("q")).select("n", "q.share", "q.value")
    values = rows.groupBy(F.col("request_count").alias("v")).agg(F.count(F.lit(1)).alias("rows"))
    ranks = values.join(F.broadcast(asked), F.col("v") <= F.col("value")).groupBy("share", "n").agg(
        F.sum("rows").alias("at_most"), F.sum(F.when(F.col("v") < F.col("value"), F.col("rows"))).alias("below")
    )
    inside = (F.col("at_most") >= (F.col("share") - 0.01) * F.col("n")) & (
        F.coalesce("below", F.lit(0)) <= (F.col("share") + 0.01) * F.col("n")
    )
    dates = sketches.agg(F.count(F.lit(1))).scalar()
    return ranks.select("share", "n", dates.alias("dates"), inside.alias("inside"))


@query
def anomaly_features(spark, sf):
    return rollups.by_bucket(_recent_hourly(spark, sf))


@query
def anomaly_baseline(spark, sf):
    hours = rollups.by_bucket(_recent_hourly(spark, sf))
    return rollups.baseline(hours).withColumn(
        "baseline_std_requests", F.round("baseline_std_requests", 6)
    )


@query
def rolling_window_7d_by_6h(spark, sf):
    return rollups.sliding_totals(M.hourly_sums(spark, sf))


# The same operators over the larger hourly table.


@query
def large_rollup_by_bucket(spark, sf):
    return rollups.by_bucket(M.hourly_from_lineitem(spark, sf))


@query
def large_geo_country_distribution(spark, sf):
    return rollups.country_distribution(M.hourly_from_lineitem(spark, sf))


@query
def large_request_quantiles(spark, sf):
    rows = features.cluster_input(M.hourly_from_lineitem(spark, sf))
    return rollups.exact_quantiles(rows, "request_count", personas.NAMING_QUANTILES)


@query
def large_persona_profiles(spark, sf):
    rows = M.clustered(M.hourly_from_lineitem(spark, sf))
    return personas.in_order(personas.profiles(personas.measures(rows))).drop("top_countries")


# --- event breakdown -------------------------------------------------------


@query
def fw_by_action(spark, sf):
    return breakdown.value_counts(_recent_firewall(spark, sf, placed=False), "action")


@query
def fw_by_source(spark, sf):
    return breakdown.value_counts(M.event_counts(spark, sf, M.as_of(spark, sf)), "source", weight="n")


@query
def fw_top_countries(spark, sf):
    return breakdown.value_counts(M.event_counts(spark, sf, M.as_of(spark, sf)), "country", 10, "n")


@query
def fw_top_paths(spark, sf):
    return breakdown.value_counts(_recent_firewall(spark, sf, placed=False), "request_path", 15)


@query
def fw_top_user_agents(spark, sf):
    top = breakdown.value_counts(_recent_firewall(spark, sf, placed=False), "user_agent", 10)
    return top.withColumnRenamed("user_agent", "ua")


# --- table maintenance -----------------------------------------------------


@query
def upsert_hourly_last_wins(spark, sf):
    first, second = (written(pull, "pull") for pull in M.hourly_batches(spark, sf))
    return maintain.upsert_hourly(first, second).drop("content_type", "ingest_seq")


@query
def upsert_across_runs(spark, sf):
    """Three loads, the last one stands: the second has the first's pull time, the third
    an older one, and each numbers its rows anew. The third holds the hours 00 to 05."""
    store = Store(spark, scratch_path(spark, "runs"))
    ht = checkpoint(M.hourly_traffic(spark, sf).where(F.col("country").isNotNull()))
    for add, pulled in ((0, "2024-02-02T00:00:00Z"), (1, "2024-02-02T00:00:00Z"), (2, "2024-02-01T00:00:00Z")):
        rows = ht.withColumns(
            {
                "request_count": F.col("request_count") + add,
                "collected_at": F.lit(pulled),
                "ingest_seq": F.col("ingest_seq") - 1000 * add,
            }
        )
        store.load(f"run-{add}", hourly=rows if add < 2 else rows.where(F.substring("bucket", 12, 2) < "06"))
    return store.read("hourly_traffic").select("collected_at", "bucket", "country", "request_count")


@query
def repair_across_runs(spark, sf):
    """Rows without method in every run keep the first run's; two countries that become
    one by the fill add up. Row numbers restart, and fall, from run to run."""
    store = Store(spark, scratch_path(spark, "repair"))
    ht = checkpoint(M.hourly_traffic(spark, sf))
    for add in (0, 1, 2):
        rows = ht.withColumns(
            {
                "http_method": F.lit(None).cast("string"),
                "country": F.when(F.col("country") == "NATION_1", "Unknown").otherwise(F.col("country")),
                "request_count": F.col("request_count") + add,
                "ingest_seq": F.col("ingest_seq") - 1000 * add,
            }
        )
        store.load(f"run-{add}", hourly=rows)
    store.repair_hourly()
    return store.read("hourly_traffic").select("bucket", "country", "http_method", "request_count")


@query
def src_landing_order(spark, sf):
    """Two landings of every hour, the later one larger for even hours and smaller for
    odd ones. What arrived last stands; rows without country match nothing and all stay."""
    path = scratch_path(spark, "landing")
    landed = checkpoint(
        M.hourly_payload(spark, sf).withColumn("odd", F.substring("bucket", 13, 1).cast("int") % 2 == 1)
    )
    wide = F.concat("payload", F.repeat(F.lit(" "), 500))
    old = F.regexp_replace("payload", '"requests":', '"requests":1')
    for text in (
        F.when(F.col("odd"), F.concat(old, F.repeat(F.lit(" "), 500))).otherwise(old),
        F.when(F.col("odd"), F.col("payload")).otherwise(wide),
    ):
        files = landed.select(F.substring("bucket", 1, 10).alias("day"), text.alias("value"))
        files.repartition("day").write.mode("append").partitionBy("day").text(path)
    store = Store(spark, scratch_path(spark, "landed"))
    store.load("all", hourly=feeds.flatten_hourly(feeds.read_landing(spark, path), M.PULL_2))
    return store.read("hourly_traffic").select("bucket", "country", "request_count", "bytes_total")


@query
def insert_firewall_first_wins(spark, sf):
    first, second = (written(pull, "pull") for pull in M.firewall_batches(spark, sf))
    return maintain.insert_events(maintain.first_write_wins(first), second).select(
        "collected_at", "event_datetime", "action", "country", "source", "ray_name"
    )


@query
def dedupe_hourly_keep_first(spark, sf):
    return maintain.keep_first(M.dirty_hourly(spark, sf)).select(
        *HOURLY, "request_count", "ingest_seq"
    )


@query
def duplicate_keys(spark, sf):
    return maintain.duplicate_keys(M.dirty_hourly(spark, sf))


@query
def normalize_null_dims(spark, sf):
    return maintain.fill_null_dims(M.dirty_hourly(spark, sf)).select(
        *HOURLY, "request_count", "ingest_seq"
    )


@query
def append_details(spark, sf):
    """Two pulls, the second of them loaded again a day later: nothing collapses."""
    rd = M.request_details(spark, sf)
    again = F.when(F.col("bucket") == M.PULL_2, F.array(F.lit(M.PULL_2), F.lit("2024-01-17T00:00:00Z")))
    loads = rd.withColumn("collected_at", F.explode(F.coalesce(again, F.array(F.lit(M.PULL_2)))))
    first = loads.where(F.col("collected_at") == M.PULL_2)
    second = loads.where(F.col("collected_at") != M.PULL_2)
    return maintain.append_details(first, second).drop("ingest_seq")


@query
def append_details_newest(spark, sf):
    """The same pulls; of each request group the newest stays."""
    rd = M.request_details(spark, sf)
    pulls = F.array(F.lit(M.PULL_2), F.lit("2024-01-17T00:00:00Z"))
    loads = rd.withColumn("collected_at", F.explode(F.when(F.col("path") != "/k/4", pulls).otherwise(F.slice(pulls, 1, 1))))
    loads = loads.withColumn(
        "request_count", F.col("request_count") + F.when(F.col("collected_at") == M.PULL_2, 0).otherwise(7)
    )
    first = loads.where(F.col("collected_at") == M.PULL_2)
    second = loads.where(F.col("collected_at") != M.PULL_2)
    return maintain.append_details(first, second, dedupe=True).drop("ingest_seq")


@query
def store_unfinished_run(spark, sf):
    """A load that stopped after its first table and is repeated, over dates that were
    loaded before: every row once, and nothing of the stopped load besides."""
    store = Store(spark, scratch_path(spark, "unfinished"))
    ht = written(M.hourly_traffic(spark, sf), "hours")
    fe = written(M.firewall_events(spark, sf), "events")
    early = F.col("bucket") < M.PULL_2
    store.load("r1", hourly=ht.where(early), firewall=fe.where(F.col("event_datetime") < M.PULL_2))
    again = ht.where(F.col("bucket") >= "2024-01-10T00:00:00Z").withColumn("request_count", F.col("request_count") + 1)
    Store(spark, store.root)._upsert(store._numbered(again, 1), 1)  # as far as the stopped load came
    store.load("r2", hourly=again, firewall=fe)

    def seen(table: str, amount: Column) -> DataFrame:
        return store.read(table).agg(
            F.lit(table).alias("table"), F.count(F.lit(1)).alias("n"), F.sum(amount).cast("bigint").alias("amount")
        )

    return seen("hourly_traffic", F.col("request_count")).unionByName(seen("firewall_events", F.col("ingest_seq")))


# --- features and personas -------------------------------------------------

CODED = ["country_code", "request_count", "bytes_total", "threats"]


def _coded(spark: SparkSession, sf: str) -> DataFrame:
    rows = features.cluster_input(M.hourly_sums(spark, sf))
    return features.with_codes(rows, "country", "country_code")


@query
def feature_country_code(spark, sf):
    return _coded(spark, sf).groupBy("country", "country_code").agg(
        F.count(F.lit(1)).alias("coded_rows")
    )


@query
def feature_zscores(spark, sf):
    scored = features.z_scores(checkpoint(_coded(spark, sf)), CODED)
    return scored.select(
        "bucket", "country", *((F.round(f"{c}_z", 6) + F.lit(0.0)).alias(f"{c}_z") for c in CODED)
    )


@query
def choose_k(spark, sf):
    rows = features.cluster_input(M.hourly_sums(spark, sf))
    return rows.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", N.cluster_count(F.col("total_rows")).alias("n_clusters")
    )


@query
def persona_profiles(spark, sf):
    profiled = personas.in_order(personas.profiles(personas.measures(_clustered(spark, sf))))
    return profiled.drop("top_countries")


@query
def persona_top_countries(spark, sf):
    return personas.top_countries(personas.profiles(personas.measures(_clustered(spark, sf))))


@query
def persona_labels(spark, sf):
    return personas.labelled_profiles(_clustered(spark, sf)).select(
        "rank", "cluster", "avg_requests", "threat_ratio", "label"
    )


@query
def view_persona_cards(spark, sf):
    return series.persona_cards(personas.labelled_profiles(_clustered(spark, sf)))


@query
def series_persona_bubbles(spark, sf):
    return series.persona_bubbles(personas.labelled_profiles(_clustered(spark, sf)))


@query
def persona_kmeans(spark, sf):
    """Profiles of a real fit over six groups that stand apart, from its document."""
    log = results.to_log(documents.persona(M.separated(M.hourly_sums(spark, sf))), "kmeans_traffic", NEVER)
    return results.parsed(log, "kmeans_traffic").select(
        "n_clusters", "total_rows_analyzed", F.inline("profiles")
    ).withColumn("top_countries", F.array_join(F.map_keys("top_countries"), ", ")).drop("cluster_id")


@query
def persona_kmeans_invariants(spark, sf):
    fitted = personas.fit(M.hourly_sums(spark, sf))
    profiled = personas.profiles(personas.measures(fitted.points, "weight"))
    return profiled.agg(
        F.lit(fitted.n_clusters).alias("n_clusters"),
        F.lit(fitted.rows).cast("bigint").alias("total_rows"),
        F.sum("size").alias("sum_size"),
        F.sum("total_threats").alias("sum_threats"),
        F.sum(F.round(F.col("size") * F.col("avg_requests")).cast("bigint")).alias("sum_requests"),
    ).join(personas.fixed_point(fitted))


# --- anomalies -------------------------------------------------------------


def _spiked(spark: SparkSession, sf: str) -> DataFrame:
    return forest.detect(M.spiked(rollups.by_bucket(_recent_hourly(spark, sf))))


@query
def anomaly_isolation_forest(spark, sf):
    """Hours a real forest flags where two stand out; scores are left out."""
    return forest.anomalies(_spiked(spark, sf)).drop("anomaly_score")


@query
def anomaly_invariants(spark, sf):
    hours = forest.detect(rollups.by_bucket(_recent_hourly(spark, sf)))
    return hours.agg(
        F.count(F.lit(1)).alias("total_buckets_analyzed"),
        F.count_if("is_anomaly").alias("anomalies_found"),
        N.contamination(F.count(F.lit(1))).alias("contamination_rate"),
        F.every((F.col("raw") >= -1) & (F.col("raw") < 0)).alias("scores_in_range"),
        F.every(F.col("is_anomaly") == (F.col("anomaly_score") < 0)).alias("flags_match_scores"),
    )


def _fitted_forest(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    """The hours of the rolling window, the node table of their forest, their number."""
    hours = checkpoint(rollups.by_bucket(_recent_hourly(spark, sf)))
    total = hours.count()
    return hours, written(forest.node_table(spark, forest.fit(hours, "bucket", total)), "nodes"), total


@query
def anomaly_scores_walked(spark, sf):
    """The vectorised scores against a walk through the node table by joins."""
    hours, nodes, total = _fitted_forest(spark, sf)
    size = min(forest.SAMPLE, total)
    score = forest.scorer(nodes.toPandas().sort_values(["tree", "node"], ignore_index=True), size)
    scored = hours.select("bucket", score(*(F.col(c) for c in forest.FEATURES)).alias("scored"))
    walked = forest.walked_scores(hours, "bucket", nodes, size)
    return scored.join(walked, "bucket", "left").select(
        "bucket", (F.abs(F.col("scored") - F.coalesce("raw", F.lit(1.0))) <= 1e-9).alias("same")
    )


@query
def anomaly_trees_grown(spark, sf):
    """Every tree against its own sample sent down it again."""
    hours, nodes, total = _fitted_forest(spark, sf)
    sampled = written(forest.sample(hours, "bucket", total), "sample")
    return forest.tree_checks(sampled, nodes)


@query
def series_traffic_marked(spark, sf):
    hours = _spiked(spark, sf)
    return series.traffic_bars(hours.select("bucket", "total_requests"), hours.where("is_anomaly"))


# --- documents as the jobs write them --------------------------------------


def _read_back(document: DataFrame, model: str) -> DataFrame:
    """A document through the log and back."""
    return results.parsed(results.to_log(document, model, NEVER), model)


@query
def doc_summary(spark, sf):
    document = documents.summary(M.hourly_sums(spark, sf), M.firewall_events(spark, sf, placed=False))
    return _read_back(document, "summary").drop("run_at")


@query
def doc_geo(spark, sf):
    document = _read_back(documents.geo(M.hourly_sums(spark, sf)), "geo_analysis")
    return document.select("total_countries", "total_requests", F.posexplode("countries").alias("place", "c")).select(
        "total_countries", "total_requests", "place", "c.*"
    )


@query
def doc_firewall(spark, sf):
    """Every list of the event breakdown, one row per entry."""
    now = M.as_of(spark, sf)
    doc = _read_back(documents.firewall(M.firewall_events(spark, sf, now), now), "firewall_analysis")
    doc = checkpoint(doc)

    def entries(name: str, pairs: Column) -> DataFrame:
        listed = doc.select("total_events", F.posexplode(pairs).alias("place", "e"))
        fields = listed.schema["e"].dataType.fieldNames()
        return listed.select(
            "total_events", F.lit(name).alias("list"), "place",
            F.col(f"e.{fields[0]}").alias("value"), F.col(f"e.{fields[1]}").alias("count"),
        )

    lists = [entries(name, F.map_entries(name)) for name in ("by_action", "by_source", "top_paths")]
    lists += [entries(name, F.col(name)) for name in ("top_countries", "top_user_agents")]
    return reduce(DataFrame.unionByName, lists)


@query
def action_shares(spark, sf):
    now = M.as_of(spark, sf)
    fe = M.firewall_events(spark, sf, now)
    return series.action_shares(_read_back(documents.firewall(fe, now), "firewall_analysis"))


def _persona_document(spark: SparkSession, sf: str) -> DataFrame:
    labelled = personas.labelled_profiles(_clustered(spark, sf))
    rows = F.aggregate("profiles", F.lit(0).cast("bigint"), lambda n, p: n + p["size"])
    return documents.persona_document(labelled, F.size("profiles"), rows, F.lit(0.0))


@query
def doc_persona(spark, sf):
    """The persona document over a fixed assignment."""
    document = _read_back(_persona_document(spark, sf), "kmeans_traffic")
    profiles = document.select("n_clusters", "total_rows_analyzed", F.inline("profiles"))
    return profiles.withColumn("top_countries", F.array_join(F.map_keys("top_countries"), ", "))


@query
def anomaly_table(spark, sf):
    """The two busiest hours as a table, with a given score."""
    hours = M.spiked(rollups.by_bucket(_recent_hourly(spark, sf))).withColumn("anomaly_score", F.lit(-0.125))
    return series.anomaly_table(hours.orderBy(F.desc("total_requests"), "bucket").limit(2))


@query
def doc_anomaly_header(spark, sf):
    now = M.as_of(spark, sf)
    document = documents.anomaly(M.hourly_sums(spark, sf, now), now)
    return _read_back(document, "isolation_forest").select(
        "total_buckets_analyzed",
        "contamination_rate",
        F.round("baseline_mean_requests", 6).alias("baseline_mean_requests"),
        F.round("baseline_std_requests", 6).alias("baseline_std_requests"),
    )


@query
def view_anomaly_header(spark, sf):
    hours = rollups.by_bucket(_recent_hourly(spark, sf))
    return series.anomaly_header(rollups.baseline(hours).withColumn("anomalies_found", F.lit(2)))


@query
def view_persona_header(spark, sf):
    return series.persona_header(_persona_document(spark, sf))


# --- scalar functions ------------------------------------------------------


@query
def scalar_time_format(spark, sf):
    ts = M.table(spark, sf, "events").select(
        T.iso_hour(F.col("ts")).alias("bucket"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    )
    b = F.col("bucket")
    return ts.distinct().select(
        b,
        T.hour_of_iso(F.concat(F.substring(b, 1, 14), F.lit("17:42Z"))).alias("hour"),
        T.cutoff(F.col("day"), days=7, hours=3).alias("week_before"),
        T.display(b).alias("shown"),
        T.display(F.concat(F.lit("bad "), b)).alias("shown_bad"),
        T.axis_label(b).alias("axis"),
        T.date_of_iso(b).alias("date"),
    )


@query
def scalar_numeric_guard(spark, sf):
    requests, threats = F.col("request_count"), F.col("threats")
    return M.hourly_traffic(spark, sf).select(
        "bucket",
        F.coalesce("country", F.lit("Unknown")).alias("country"),
        N.share_pct(threats, requests).alias("share_pct"),
        N.threat_pct(threats, requests).alias("threat_pct"),
        N.ratio(requests, threats).alias("ratio"),
        N.cluster_count(requests).alias("clusters"),
        N.contamination(requests).alias("contamination"),
        F.round(N.megabytes(F.col("bytes_total")), 6).alias("megabytes"),
        F.round(N.bubble_radius(F.col("unique_visitors")), 6).alias("radius"),
        N.palette_index(requests).alias("colour"),
        N.severity(N.ratio(threats, requests), requests).alias("icon"),
        N.thousands(F.col("bytes_total")).alias("bytes_shown"),
    )


# --- streaming -------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = M.table(spark, sf, "events").schema
    return M.with_k(ingest.stream_files(spark, sf, schema, "events.parquet"))


def _stream_hours(spark: SparkSession, sf: str, events: DataFrame, settled: bool = False) -> DataFrame:
    zoned = events.withColumn("ts", F.col("ts").cast("timestamp"))
    placed = zoned.join(M.places(spark, sf), "user_id").withColumn("country", M.country())
    rollup = ingest.settled_hours if settled else ingest.hourly_rollup
    return rollup(placed, ["country"], M.event_sums())


@query
def stream_ingest(spark, sf):
    rows = M.firewall_rows(_event_stream(spark, sf))
    path = scratch_path(spark, "ingest")
    ingest.append_rows(rows, f"{path}/checkpoint", f"{path}/rows")
    return spark.read.schema(rows.schema).parquet(f"{path}/rows").drop("ingest_seq")


@query
def stream_hourly_rollup(spark, sf):
    path = scratch_path(spark, "rollup")
    hours = _stream_hours(spark, sf, _event_stream(spark, sf))
    newest = ingest.write_totals(hours, f"{path}/checkpoint", f"{path}/rows")
    return spark.read.schema(hours.schema).parquet(newest)


@query
def stream_upsert(spark, sf):
    """Two runs over landed events; the hours a run changes are overwritten."""
    path = scratch_path(spark, "upsert")
    events = M.table(spark, sf, "events")
    store = Store(spark, f"{path}/store")
    split = F.lit("2024-01-16 00:30:00").cast("timestamp_ntz")
    for part in (F.col("ts") < split, F.col("ts") >= split):
        events.where(part).write.mode("append").parquet(f"{path}/landing")
        landed = ingest.stream_files(spark, f"{path}/landing", events.schema)
        hours = M.as_hourly_rows(_stream_hours(spark, sf, M.with_k(landed), settled=True))
        ingest.upsert_hours(hours, f"{path}/checkpoint", store, "hours")
    return store.read("hourly_traffic").select("bucket", "country", *M.COUNTERS)


@query
def stream_upsert_unknown(spark, sf):
    """Events without country and events of an ``Unknown`` one in the same hours: the
    totals hold both."""
    path = scratch_path(spark, "unknown")
    store = Store(spark, f"{path}/store")
    places = M.places(spark, sf).withColumn("n_name", F.when(F.col("n_name") == "NATION_1", "Unknown").otherwise(F.col("n_name")))
    events = _event_stream(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    placed = events.join(places, "user_id").withColumn("country", M.country())
    hours = M.as_hourly_rows(ingest.settled_hours(placed, ["country"], M.event_sums()))
    ingest.upsert_hours(hours, f"{path}/checkpoint", store, "hours")
    return store.read("hourly_traffic").select("bucket", "country", *M.COUNTERS)


SPLIT = "2024-01-16 00:30:00"


def _two_runs(spark: SparkSession, sf: str, path: str):
    """The stream of landed events, before and after the second half of them landed."""
    events = M.table(spark, sf, "events")
    split = F.lit(SPLIT).cast("timestamp_ntz")
    for part in (F.col("ts") < split, F.col("ts") >= split):
        events.where(part).write.mode("append").parquet(f"{path}/landing")
        landed = ingest.stream_files(spark, f"{path}/landing", events.schema)
        yield M.with_k(landed).withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_rolling_7d(spark, sf):
    """Two runs over landed events; the open windows of both grow on."""
    path = scratch_path(spark, "rolling")
    sums = {"total_requests": M.event_sums()["request_count"], "total_threats": M.event_sums()["threats"]}
    for events in _two_runs(spark, sf, path):
        windows_ = ingest.rolling_totals(events, sums)
        ingest.write_changes(windows_, f"{path}/checkpoint", f"{path}/rows")
    return ingest.newest_changes(spark, f"{path}/rows", windows_.schema, ["window_start", "window_end"])


@query
def stream_closed_hours(spark, sf):
    """Two runs; an hour is written once, when no event of it can come any more."""
    path = scratch_path(spark, "closed")
    for events in _two_runs(spark, sf, path):
        placed = events.join(M.places(spark, sf), "user_id").withColumn("country", M.country())
        hours = ingest.settled_hours(placed, ["country"], M.event_sums())
        ingest.append_rows(hours, f"{path}/checkpoint", f"{path}/rows")
    return spark.read.schema(hours.schema).parquet(f"{path}/rows")


@query
def stream_dedupe_recent(spark, sf):
    """Two runs of events that all arrive twice, some with an empty id and some without:
    one of each id stays, the empty one included, and all without."""
    path = scratch_path(spark, "recent")
    for events in _two_runs(spark, sf, path):
        rows = M.firewall_rows(events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))), F.col("ts"))
        some = F.when(F.col("ingest_seq") % 100 != 50, F.col("ray_name"))
        kept = ingest.dedupe_recent(rows.withColumn("ray_name", some))
        ingest.insert_recent(kept, f"{path}/checkpoint", f"{path}/rows")
    return spark.read.schema(kept.schema).parquet(f"{path}/rows").select("event_datetime", "action", "ray_name")


@query
def stream_retrain(spark, sf):
    """Three landed pulls; each one is loaded and all models are trained again on it.
    Events with an empty id come without, so that all of them count."""
    path = scratch_path(spark, "retrain")
    store = Store(spark, f"{path}/store")
    hourly = written(M.hourly_payload(spark, sf), "responses")
    now = M.as_of(spark, sf)
    fe = M.firewall_events(spark, sf)
    fe = written(fe.withColumn("ray_name", F.nullif("ray_name", F.lit(""))), "events")
    starts = ["2024-01-01T00:00:00Z", "2024-01-11T00:00:00Z", "2024-01-21T00:00:00Z", now.replace(" ", "T")[:19] + "Z"]
    for pull, (start, end) in enumerate(zip(starts, starts[1:])):
        last = pull == len(starts) - 2

        def inside(time: str) -> Column:
            return (F.col(time) >= start) & ((F.col(time) <= end) if last else (F.col(time) < end))

        hourly.where(inside("bucket")).select(F.col("payload").alias("value")).write.mode("append").text(f"{path}/landing/hourly")
        pulled = M.firewall_responses(fe.where(inside("event_datetime")))
        pulled.select(F.col("payload").alias("value")).write.mode("append").text(f"{path}/landing/firewall")
        jobs.retrain_on_arrival(store, f"{path}/landing", f"{path}/place", f"{path}/log", end)
    log = results.read_log(spark, f"{path}/log")
    return log.select("run_at", "model_name", "ingest_seq", _headline())


@query
def stream_dedupe(spark, sf):
    """Two runs over landed pulls that overlap; the first write of an id stays."""
    path = scratch_path(spark, "dedupe")
    store = Store(spark, f"{path}/store")
    for pull in M.firewall_batches(spark, sf):
        pull.write.mode("append").parquet(f"{path}/landing")
        landed = ingest.stream_files(spark, f"{path}/landing", S.FIREWALL_EVENTS)
        ingest.insert_new_events(landed, f"{path}/checkpoint", store, "events")
    return store.read("firewall_events").select(
        "collected_at", "event_datetime", "action", "ray_name"
    )

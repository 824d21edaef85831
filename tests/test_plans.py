"""What the plans must look like to hold at scale."""

import pytest
from pyspark.sql import functions as F

from edgelens.catalog import mapping as M
from edgelens.catalog.queries import QUERIES
from edgelens.operators import breakdown, features, maintain, rollups, windows
from edgelens.session import written
from edgelens.sources.store import Store

LAZY = [
    "src_hourly_flatten",
    "src_firewall_flatten",
    "src_details_flatten",
    "filter_rolling_7d",
    "filter_open_interval",
    "rollup_by_bucket",
    "geo_country_distribution",
    "series_traffic",
    "series_mark_join",
    "summary_stats",
    "anomaly_features",
    "rolling_window_7d_by_6h",
    "fw_by_source",
    "fw_top_paths",
    "upsert_hourly_last_wins",
    "insert_firewall_first_wins",
    "dedupe_hourly_keep_first",
    "duplicate_keys",
    "append_details",
    "feature_country_code",
    "persona_profiles",
    "latest_result_per_model",
]


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_of_all_rows(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


@pytest.mark.parametrize("name", ["filter_rolling_7d", "series_traffic", "fw_by_action", "filter_open_interval"])
def test_window_filters_reach_the_scan(spark, sf, name):
    formatted = QUERIES[name](spark, sf)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "GreaterThanOrEqual(ts," in formatted


def test_only_needed_columns_are_read(spark, sf):
    text = plan(QUERIES["fw_by_action"](spark, sf))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in text
    assert "customer.parquet" not in text


@pytest.mark.parametrize(
    "rule",
    [maintain.last_write_wins, maintain.keep_first],
)
def test_hourly_keys_are_cut_before_the_shuffle(hourly, rule):
    text = plan(rule(hourly(("b", "US", 1))))
    assert "row_number(), 1, Partial" in text and "row_number(), 1, Final" in text
    assert text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("rule", [maintain.last_write_wins, maintain.first_write_wins])
def test_rows_without_a_key_share_the_window(hourly, events, rule):
    """No second branch for them: what is below is planned and read once."""
    rows = hourly(("b", "US", 1)) if rule is maintain.last_write_wins else events(("t", "x", "a"))
    text = plan(rule(written(rows, "rows")))
    assert text.count("FileScan") == 1 and "Union" not in text


@pytest.mark.parametrize("name", ["src_hourly_flatten", "src_firewall_flatten", "src_details_flatten"])
def test_responses_are_parsed_once(spark, sf, name):
    optimized = QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("from_json(") == 1


def test_inserts_read_each_pull_as_often_as_their_rule_asks(spark, sf):
    text = plan(QUERIES["insert_firewall_first_wins"](spark, sf)).split("== Initial Plan ==")[-1]
    # The first pull is kept and probed, the second is inserted and probes.
    assert text.count("FileScan") <= 5


def test_event_ids_are_cut_before_the_shuffle(events):
    text = plan(maintain.first_write_wins(events(("t", "x", "a"))))
    assert "row_number(), 1, Partial" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_history_is_probed_not_shuffled(spark, tmp_path, events):
    """A batch below the broadcast threshold reads the id column of the history only."""
    store = Store(spark, str(tmp_path / "store"))
    store.load("r1", firewall=events(*(("2024-01-01T00:00:00Z", "x", f"r{i}") for i in range(50))))
    batch = written(events(("t", "x", "r1"), ("t", "x", "new")), "batch")
    fresh = maintain.new_events(store.read("firewall_events"), batch)
    text = plan(fresh)
    history = text[text.index("LeftSemi") :].splitlines()
    scan = next(i for i, line in enumerate(history) if "FileScan" in line)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert "Exchange" not in "".join(history[:scan])
    assert "ReadSchema: struct<ray_name:string>" in history[scan]
    assert [r.ray_name for r in fresh.collect()] == ["new"]


def test_ranked_lists_are_cut_before_the_shuffle(spark):
    columns = ", ".join(f"{c} string" for c in breakdown.BREAKDOWN_LIMITS)
    frame = spark.createDataFrame([("a", "s", "c", "p", "u")], columns)
    assert "row_number(), 15, Partial" in plan(breakdown.breakdown(frame))
    assert "TakeOrderedAndProject" in plan(breakdown.value_counts(frame, "request_path", 15))


def test_country_totals_share_the_aggregation(spark, sf):
    frame = rollups.country_distribution(M.hourly_traffic(spark, sf))
    frame.collect()
    text = plan(frame).split("== Initial Plan ==")[0]
    assert "TakeOrderedAndProject" in text and "ReusedExchange" in text


def test_stored_window_opens_only_its_dates(spark, tmp_path, hourly):
    store = Store(spark, str(tmp_path / "store"))
    store.load("r1", hourly=hourly(*((f"2024-01-{d:02d}T00:00:00Z", "US", d) for d in range(1, 29))))
    recent = windows.rolling_window(store.read("hourly_traffic"), "bucket", "2024-01-28T12:00:00Z")
    scan = next(line for line in plan(recent).splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(dt#" in scan
    assert recent.count() == 7


def test_hot_key_survives(spark, events):
    """One id on most rows: still one row per id, and no task holds the id whole."""
    many = spark.range(0, 20_000, 1, 8).select(
        F.lit("2024-01-01T00:00:00Z").alias("collected_at"),
        F.lit("2024-01-01T00:00:00Z").alias("event_datetime"),
        F.when(F.col("id") % 3 > 0, "").otherwise(F.col("id").cast("string")).alias("ray_name"),
        F.col("id").alias("ingest_seq"),
    )
    kept = maintain.first_write_wins(many)
    assert kept.count() == 6_667 + 1
    assert kept.where("ray_name = ''").first().ingest_seq == 1


def test_codes_leave_the_rows_where_they_are(spark, hourly):
    rows = features.cluster_input(hourly(("b", "US", 1), ("b", "DE", 2)))
    coded = features.with_codes(rows, "country", "code")
    assert "BroadcastHashJoin" in plan(coded) and "Exchange hashpartitioning" not in plan(coded)
    assert sorted((r.country, r.code) for r in coded.collect()) == [("DE", 0), ("US", 1)]


@pytest.mark.parametrize(
    "name",
    ["rollup_by_bucket", "geo_country_distribution", "series_traffic", "summary_stats", "rolling_window_7d_by_6h"],
)
def test_sums_without_visitors_do_not_shuffle_by_user(spark, sf, name):
    assert "hashpartitioning(user_id" not in plan(QUERIES[name](spark, sf))
    assert "user_id" in plan(QUERIES[name](spark, sf))

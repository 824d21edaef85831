import json

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from edgelens import schemas as S
from edgelens.operators import maintain
from edgelens.sources.store import Store
from edgelens.streaming import ingest

EVENT = "ts timestamp, country string, n bigint"


@pytest.fixture
def landing(tmp_path):
    return str(tmp_path / "landing")


def land(frame, path):
    frame.write.mode("append").parquet(path)


def at(spark, *rows):
    return spark.createDataFrame(rows, "ts string, country string, n bigint").withColumn(
        "ts", F.to_timestamp("ts")
    )


def hours(spark, landing, settled):
    stream = ingest.stream_files(spark, landing, at(spark, ("2024-01-01 00:00:00", "US", 1)).schema)
    rollup = ingest.settled_hours if settled else ingest.hourly_rollup
    return rollup(stream, ["country"], {"request_count": F.sum("n")})


FIRST = [("2024-01-01 10:10:00", "US", 1), ("2024-01-01 10:50:00", "US", 2), ("2024-01-01 11:00:00", None, 4)]
SECOND = [("2024-01-01 10:59:59", "US", 8), ("2024-01-02 09:00:00", "DE", 16)]


def test_totals_cover_all_runs(spark, landing, tmp_path):
    for part in (FIRST, SECOND):
        land(at(spark, *part), landing)
        frame = hours(spark, landing, settled=False)
        newest = ingest.write_totals(frame, str(tmp_path / "cp"), str(tmp_path / "out"))
    assert rows_of(spark.read.parquet(newest)) == [
        ("2024-01-01T10:00:00Z", "US", 11),
        ("2024-01-01T11:00:00Z", None, 4),
        ("2024-01-02T09:00:00Z", "DE", 16),
    ]


def as_hours(frame):
    dims = {"http_method": F.lit(""), "status_code": F.lit(0), "content_type": F.lit("")}
    zeros = {c: F.lit(0).cast("bigint") for c in ("bytes_total", "threats", "unique_visitors")}
    return frame.withColumns({"collected_at": F.lit("2024-01-03T00:00:00Z")} | dims | zeros)


def test_changed_hours_overwrite_the_table(spark, landing, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    for part in (FIRST, SECOND, [("2024-01-01 11:30:00", None, 32)]):
        land(at(spark, *part), landing)
        ingest.upsert_hours(as_hours(hours(spark, landing, settled=True)), str(tmp_path / "cp"), store, "h")
    assert rows_of(store.read("hourly_traffic"), "bucket", "country", "request_count") == [
        ("2024-01-01T10:00:00Z", "US", 11),
        ("2024-01-01T11:00:00Z", "Unknown", 36),
        ("2024-01-02T09:00:00Z", "DE", 16),
    ]


def test_events_later_than_the_bound_leave_settled_hours_alone(spark, landing, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    runs = [
        [("2024-01-01 10:00:00", "US", 1), ("2024-01-03 10:00:00", "US", 1)],
        [("2024-01-01 10:30:00", "US", 100), ("2024-01-02 10:30:00", "US", 5)],
    ]
    for part in runs:
        land(at(spark, *part), landing)
        ingest.upsert_hours(as_hours(hours(spark, landing, settled=True)), str(tmp_path / "cp"), store, "h")
    assert rows_of(store.read("hourly_traffic"), "bucket", "request_count") == [
        ("2024-01-01T10:00:00Z", 1),
        ("2024-01-02T10:00:00Z", 5),
        ("2024-01-03T10:00:00Z", 1),
    ]


def test_pulled_hours_stream_like_the_batch_upsert(spark, landing, tmp_path, hourly):
    store = Store(spark, str(tmp_path / "store"))
    a = hourly(("2024-01-01T00:00:00Z", "US", 1), ("2024-01-01T00:00:00Z", None, 2))
    b = hourly(("2024-01-01T00:00:00Z", "US", 9), ("2024-01-01T01:00:00Z", "US", 3), collected_at="2024-01-02T00:00:00Z")
    for pull in (a, b):
        land(pull, landing)
        stream = ingest.stream_files(spark, landing, S.HOURLY_TRAFFIC)
        ingest.upsert_hours(stream, str(tmp_path / "cp"), store, "h", mode="append")
    stored = store.read("hourly_traffic").drop("dt", "arrival")
    assert rows_of(stored) == rows_of(maintain.upsert_hourly(a, b).drop("arrival"))


def test_new_events_stream_like_the_batch_insert(spark, landing, tmp_path, events):
    store = Store(spark, str(tmp_path / "store"))
    a = events(("2024-01-01T00:00:00Z", "x", "a"), ("2024-01-01T00:00:00Z", "x", ""), ("2024-01-01T00:00:00Z", "x", None))
    b = events(("2024-01-02T00:00:00Z", "y", "a"), ("2024-01-02T00:00:00Z", "y", "b"), ("2024-01-02T00:00:00Z", "y", None), collected_at="2024-01-02T00:00:00Z")
    for pull in (a, b):
        land(pull, landing)
        stream = ingest.stream_files(spark, landing, S.FIREWALL_EVENTS)
        ingest.insert_new_events(stream, str(tmp_path / "cp"), store, "e")
    stored = store.read("firewall_events").drop("dt", "run_id", "arrival")
    assert rows_of(stored) == rows_of(maintain.insert_events(a, b).drop("arrival"))


def test_dedupe_within_the_bound(spark, landing, tmp_path):
    schema = "ts timestamp, ray_name string"
    rows = [("2024-01-01 10:00:00", "a"), ("2024-01-01 10:00:00", "b"), ("2024-01-01 12:00:00", "a")]
    land(spark.createDataFrame(rows, "ts string, ray_name string").withColumn("ts", F.to_timestamp("ts")), landing)
    stream = ingest.stream_files(spark, landing, spark.createDataFrame([], schema).schema)
    ingest.append_rows(ingest.dedupe_recent(stream), str(tmp_path / "cp"), str(tmp_path / "out"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out")), "ray_name") == [("a",), ("b",)]


def _event_rows(spark, *rows):
    frame = spark.createDataFrame(rows, "ts string, ray_name string, ingest_seq bigint")
    return frame.withColumns({"ts": F.to_timestamp("ts"), "event_datetime": F.col("ts")})


def test_events_without_id_meet_the_others_in_one_table(spark, landing, tmp_path):
    """Null ids all stay, of empty ids the first of the first batch, over batches and replays."""
    runs = [
        [("2024-01-01 10:00:00", "a", 5), ("2024-01-01 10:05:00", "", 7), ("2024-01-01 10:01:00", "", 6), ("2024-01-01 10:00:00", None, 1), ("2024-01-01 10:00:00", None, 1)],
        [("2024-01-01 11:00:00", "a", 8), ("2024-01-01 11:00:00", "b", 9), ("2024-01-01 11:00:00", "", 2), ("2024-01-01 11:00:00", None, 3)],
        [("2024-01-01 12:00:00", "", 1)],
    ]
    out = str(tmp_path / "out")
    for part in runs:
        land(_event_rows(spark, *part).drop("event_datetime"), landing)
        stream = ingest.stream_files(spark, landing, _event_rows(spark, *runs[0]).drop("event_datetime").schema)
        stream = stream.withColumn("event_datetime", F.col("ts").cast("string"))
        ingest.insert_recent(ingest.dedupe_recent(stream), str(tmp_path / "cp"), out)
    assert rows_of(spark.read.parquet(out), "ray_name", "ingest_seq") == [
        ("", 6), ("a", 5), ("b", 9), (None, 1), (None, 1), (None, 3),
    ]


def test_rolling_windows_grow_and_settle(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    for part in (FIRST, SECOND, [("2024-02-20 00:00:00", "US", 1)], [("2024-01-01 00:00:00", "US", 1000)]):
        land(at(spark, *part), landing)
        stream = ingest.stream_files(spark, landing, at(spark, *FIRST).schema)
        totals = ingest.rolling_totals(stream, {"n": F.sum("n")})
        ingest.write_changes(totals, str(tmp_path / "cp"), out)
    newest = ingest.newest_changes(spark, out, totals.schema, ["window_start", "window_end"])
    got = {r.window_start: r.n for r in newest.collect()}
    # 32 marks reach an event of the first days; the last event opens 28 more; the late one changes nothing.
    assert len(got) == 32 + 28
    assert got["2024-01-01T06:00:00Z"] == 31 and got["2024-01-02T06:00:00Z"] == 16 and got["2023-12-25T12:00:00Z"] == 15


def test_hours_close_once(spark, landing, tmp_path):
    out = str(tmp_path / "out")
    for part in (FIRST, SECOND, [("2024-01-02 13:00:00", "US", 1), ("2024-01-01 11:59:00", "US", 64)]):
        land(at(spark, *part), landing)
        ingest.append_rows(hours(spark, landing, settled=True), str(tmp_path / "cp"), out)
    # 25 hours before the newest event, hour 10 is over; what came for hour 11 in time is in the state.
    assert rows_of(spark.read.parquet(out), "bucket", "country", "request_count") == [
        ("2024-01-01T10:00:00Z", "US", 11), ("2024-01-01T11:00:00Z", "US", 64), ("2024-01-01T11:00:00Z", "Unknown", 4),
    ]


def test_append_reads_each_file_once(spark, landing, tmp_path):
    for part in (FIRST, SECOND):
        land(at(spark, *part), landing)
        stream = ingest.stream_files(spark, landing, at(spark, *FIRST).schema, files=1)
        ingest.append_rows(stream, str(tmp_path / "cp"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_landed_responses_load_as_they_arrive(spark, tmp_path):
    def respond(feed, name, entry):
        folder = tmp_path / "landing" / name
        folder.mkdir(parents=True, exist_ok=True)
        text = json.dumps({"data": {"viewer": {"zones": [{feed: [entry]}]}}})
        (folder / f"{len(list(folder.iterdir()))}.json").write_text(text + "\n")

    def hour(n):
        return {
            "dimensions": {"datetime": "2024-01-01T00:00:00Z"},
            "sum": {"requests": n, "bytes": 1, "threats": 0, "countryMap": []},
            "uniq": {"uniques": 1},
        }

    store = Store(spark, str(tmp_path / "store"))
    for n, as_of in ((5, "2024-01-01T06:00:00Z"), (7, "2024-01-01T12:00:00Z")):
        respond(S.HOURLY_FEED, "hourly", hour(n))
        respond(S.FIREWALL_FEED, "firewall", {"datetime": "2024-01-01T01:00:00Z", "rayName": "a", "action": str(n)})
        respond(S.DETAILS_FEED, "details", {"count": n, "dimensions": {}})
        start = F.lit("2023-12-31T07:30:00Z")
        ingest.load_landed(store, str(tmp_path / "landing"), str(tmp_path / "cp"), as_of, start, "pull")
    assert rows_of(store.read("hourly_traffic"), "collected_at", "country", "request_count") == [
        ("2024-01-01T12:00:00Z", "Unknown", 7)
    ]
    assert rows_of(store.read("firewall_events"), "action") == [("5",)]
    assert rows_of(store.read("request_details"), "bucket", "request_count") == [
        ("2023-12-31T07:00:00Z", 5), ("2023-12-31T07:00:00Z", 7),
    ]

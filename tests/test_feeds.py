import json

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from edgelens import schemas as S
from edgelens.operators.maintain import last_write_wins
from edgelens.sources import feeds

AS_OF = "2024-01-31T00:00:00Z"


def landed(spark, *documents):
    texts = [(d if isinstance(d, str) else json.dumps(d),) for d in documents]
    return spark.createDataFrame(texts, "payload string")


def response(feed, *entries):
    return {"data": {"viewer": {"zones": [{feed: list(entries)}]}}}


def group(hour, countries, requests=10, uniques=4):
    total = {"requests": requests, "bytes": 1000, "threats": 2, "responseStatusMap": []}
    if countries is not Ellipsis:
        total["countryMap"] = countries
    return {"dimensions": {"datetime": hour}, "sum": total, "uniq": {"uniques": uniques}}


def country(name, n):
    return {"clientCountryName": name, "requests": n, "threats": 1, "bytes": 10 * n}


def test_hourly_rows_and_fallback(spark):
    doc = response(
        S.HOURLY_FEED,
        group("h1", [country("US", 7), country(None, 3)]),
        group("h2", []),
        group("h3", None),
        group("h4", ...),
    )
    rows = feeds.flatten_hourly(landed(spark, doc), AS_OF)
    assert rows_of(rows, "bucket", "country", "request_count", "bytes_total", "threats", "unique_visitors") == [
        ("h1", "US", 7, 70, 1, 0),
        ("h1", None, 3, 30, 1, 0),
        ("h2", "Unknown", 10, 1000, 2, 4),
        ("h3", "Unknown", 10, 1000, 2, 4),
        ("h4", "Unknown", 10, 1000, 2, 4),
    ]
    assert rows_of(rows.select("collected_at", "http_method", "status_code", "content_type").distinct()) == [
        (AS_OF, "", 0, "")
    ]


@pytest.mark.parametrize(
    "document",
    [
        {},
        {"data": None},
        {"errors": [{"message": "no"}], "data": None},
        {"data": {"viewer": None}},
        {"data": {"viewer": {"zones": []}}},
        {"data": {"viewer": {"zones": [{}]}}},
        {"data": {"viewer": {"zones": [{S.HOURLY_FEED: []}]}}},
        "not json",
        "",
    ],
)
def test_response_without_the_feed_gives_no_rows(spark, document):
    frame = landed(spark, document)
    assert feeds.flatten_hourly(frame, AS_OF).count() == 0
    assert feeds.flatten_firewall(frame, AS_OF).count() == 0
    assert feeds.flatten_details(frame, AS_OF, F.lit(AS_OF)).count() == 0


def test_only_the_first_zone_counts(spark):
    doc = response(S.FIREWALL_FEED, {"rayName": "a"})
    doc["data"]["viewer"]["zones"].append({S.FIREWALL_FEED: [{"rayName": "b"}]})
    assert rows_of(feeds.flatten_firewall(landed(spark, doc), AS_OF), "ray_name") == [("a",)]


def test_firewall_defaults(spark):
    doc = response(S.FIREWALL_FEED, {"action": "block", "rayName": ""}, {"clientIP": None})
    rows = feeds.flatten_firewall(landed(spark, doc), AS_OF)
    assert rows_of(rows, "action", "client_ip", "event_datetime", "user_agent", "ray_name") == [
        ("", "", "", "", None),
        ("block", "", "", "", ""),
    ]


def test_details_bucket_is_the_hour_the_window_starts(spark):
    doc = response(
        S.DETAILS_FEED,
        {"count": 3, "dimensions": {"clientCountryName": "US", "clientRequestPath": "/a", "edgeResponseStatus": 404}},
        {"count": 2, "dimensions": {}},
    )
    rows = feeds.flatten_details(landed(spark, doc), AS_OF, F.lit("2024-01-30T01:17:42Z"))
    assert rows_of(rows, "bucket", "country", "http_method", "status_code", "path", "request_count") == [
        ("2024-01-30T01:00:00Z", "", "", None, "", 2),
        ("2024-01-30T01:00:00Z", "US", "", 404, "/a", 3),
    ]


def test_later_rows_of_a_response_win(spark):
    doc = response(S.HOURLY_FEED, group("h1", [country("US", 1), country("DE", 5), country("US", 2)]), group("h1", [country("DE", 6)]))
    rows = feeds.flatten_hourly(landed(spark, doc, response(S.HOURLY_FEED, group("h2", [country("US", 9)]))), AS_OF)
    assert rows_of(last_write_wins(rows), "bucket", "country", "request_count") == [
        ("h1", "DE", 6), ("h1", "US", 2), ("h2", "US", 9),
    ]


def test_rejected_responses_have_a_reason(spark):
    good = response(S.HOURLY_FEED, group("h1", [country("US", 7)]))
    wrong = json.dumps(good).replace("1000", "12.5")
    lines = json.dumps(good, indent=1).split("\n")
    rows = landed(spark, good, "no json", wrong, "", *lines, {"data": None})
    bad = feeds.rejected(rows, S.HOURLY_FEED)
    counts = {r.reason: r["count"] for r in bad.groupBy("reason").count().collect()}
    assert counts["wrong type"] == 1 and counts["not json"] >= 1
    assert sum(counts.values()) >= 2 + sum(line.strip() in ("{", "}") for line in lines)
    assert rows_of(feeds.flatten_hourly(rows, AS_OF), "bucket", "request_count") == [("h1", 7)]


def test_files_rank_by_arrival_not_by_size(spark, tmp_path):
    import os

    small = json.dumps(response(S.HOURLY_FEED, group("h1", [country("US", 10)])))
    large = json.dumps(response(S.HOURLY_FEED, group("h1", [country("US", 20)]))) + " " * 5000
    for first, last in ((small, large), (large, small)):
        folder = tmp_path / f"{len(first)}"
        folder.mkdir()
        for i, text in enumerate((first, last)):
            (folder / f"{i}.json").write_text(text)
            os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
        rows = feeds.flatten_hourly(feeds.read_landing(spark, str(folder)), AS_OF)
        expected = 20 if last is large else 10
        assert rows_of(last_write_wins(rows), "request_count") == [(expected,)]

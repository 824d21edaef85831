"""The three stages end to end, from landed responses to presentation tables."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from edgelens import schemas as S
from edgelens.plans import documents, jobs
from edgelens.sources import feeds, results
from edgelens.sources.store import Store

AS_OF = "2024-01-09T00:00:00Z"


def land(folder, feed, documents_):
    os.makedirs(f"{folder}/{feed}", exist_ok=True)
    with open(f"{folder}/{feed}/pull.json", "w") as out:
        out.writelines(json.dumps(d) + "\n" for d in documents_)


def response(feed, entries):
    return {"data": {"viewer": {"zones": [{feed: entries}]}}}


def make_landing(folder):
    rng = random.Random(4)
    hours = [f"2024-01-{d:02d}T{h:02d}:00:00Z" for d in range(1, 9) for h in range(24)]
    groups = []
    for hour in hours:
        countries = [
            {"clientCountryName": c, "requests": rng.randint(5, 400), "threats": rng.randint(0, 40), "bytes": rng.randint(10, 9999)}
            for c in ("US", "DE", "FR", "BR")
        ]
        if hour == "2024-01-05T03:00:00Z":
            countries[0]["requests"] = 50_000
        groups.append(
            {
                "dimensions": {"datetime": hour},
                "sum": {"requests": rng.randint(200, 900), "bytes": rng.randint(100, 9999), "threats": 0, "countryMap": [] if hour.endswith("T07:00:00Z") else countries},
                "uniq": {"uniques": 3},
            }
        )
    land(folder, "hourly", [response(S.HOURLY_FEED, groups[:100]), response(S.HOURLY_FEED, groups[100:])])
    land(
        folder,
        "firewall",
        [
            response(
                S.FIREWALL_FEED,
                [
                    {"action": rng.choice(["block", "challenge"]), "datetime": hours[i % len(hours)], "clientCountryName": "US",
                     "clientRequestPath": f"/p{i % 40}", "userAgent": f"ua{i % 24}", "source": "waf", "rayName": f"r{i // 2}"}
                    for i in range(300)
                ],
            )
        ],
    )
    land(
        folder,
        "details",
        [response(S.DETAILS_FEED, [{"count": 5, "dimensions": {"clientCountryName": "US", "clientRequestPath": "/"}}]), "garbage"],
    )


@pytest.fixture(scope="module")
def ran(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("run"))
    make_landing(f"{base}/landing")
    store = Store(spark, f"{base}/store")
    tables = jobs.full_run(store, f"{base}/landing", f"{base}/log", f"{base}/out", AS_OF, "run-1")
    return store, base, tables


def test_tables(ran):
    store, _, _ = ran
    assert store.read("hourly_traffic").count() == 8 * (23 * 4 + 1)
    assert store.read("firewall_events").count() == 150
    assert rows_of(store.read("request_details"), "bucket", "request_count") == [("2024-01-08T01:00:00Z", 5)]


def test_every_model_has_a_document(spark, ran):
    _, base, _ = ran
    log = results.read_log(spark, f"{base}/log")
    assert rows_of(log, "model_name", "result_type") == sorted((m, t) for m, (t, _) in S.RESULTS.items())
    shown = results.with_defaults(spark, log)
    assert shown.where("has_result").count() == 5


def test_documents_read_back(spark, ran):
    _, base, _ = ran
    log = results.read_log(spark, f"{base}/log")
    summary = results.parsed(log, "summary").first()
    assert (summary.data_rows, summary.firewall_events, summary.unique_countries) == (744, 150, 5)
    assert summary.earliest_data == "2024-01-01T00:00:00Z"
    geo = results.parsed(log, "geo_analysis").first()
    assert geo.total_countries == 5 and geo.countries[0].country == "US"
    personas = results.parsed(log, "kmeans_traffic").first()
    assert personas.total_rows_analyzed == 744 and sum(p["size"] for p in personas.profiles) == 744
    means = [p.avg_requests for p in personas.profiles]
    assert means == sorted(means, reverse=True)
    anomalies = results.parsed(log, "isolation_forest").first()
    assert anomalies.total_buckets_analyzed == 168 and anomalies.anomalies_found == 2
    assert "2024-01-05T03:00:00Z" in [a.bucket for a in anomalies.anomalies]
    firewall = json.loads(log.where("model_name = 'firewall_analysis'").first().result_json)
    counts = list(firewall["by_action"].values())
    assert counts == sorted(counts, reverse=True) and firewall["total_events"] == sum(counts)
    assert len(firewall["top_paths"]) == 15 and len(firewall["top_user_agents"]) == 10


def test_presentation_tables(spark, ran):
    _, base, tables = ran

    def table(name):
        return spark.read.parquet(f"{base}/out/{name}")

    assert table("traffic_bars").where("is_anomaly").count() == 2
    assert table("traffic_bars").count() == 168
    assert table("header_cards").first().data_points == "744"
    assert table("anomaly_table").count() == 2
    assert table("persona_cards").count() == table("persona_bubbles").count() == 6
    assert table("top_countries").count() == 5
    assert {"action_shares", "threat_bars", "results"} <= set(tables)


def test_a_second_pull_is_idempotent_and_newest_document_wins(spark, ran):
    store, base, _ = ran
    assert not jobs.collect(store, f"{base}/landing", AS_OF, "run-1")
    assert jobs.collect(store, f"{base}/landing", "2024-01-09T06:00:00Z", "run-2")
    assert store.read("hourly_traffic").count() == 744
    assert store.read("firewall_events").count() == 150
    assert store.read("request_details").count() == 2
    jobs.analyze(store, f"{base}/log", "2024-01-09T06:00:00Z")
    log = results.read_log(spark, f"{base}/log")
    assert log.count() == 10
    assert {r.run_at for r in results.latest(log).collect()} == {"2024-01-09T06:00:00Z"}


def test_too_little_data_skips_the_models(spark, tmp_path, hourly):
    store = Store(spark, str(tmp_path / "store"))
    store.load("r1", hourly=hourly(*((f"2024-01-01T0{h}:00:00Z", "US", h) for h in range(4))))
    written = jobs.analyze(store, str(tmp_path / "log"), "2024-01-02T00:00:00Z")
    assert sorted(written) == ["firewall_analysis", "geo_analysis", "summary"]
    doc = json.loads(results.read_log(spark, str(tmp_path / "log")).where("model_name = 'firewall_analysis'").first().result_json)
    assert doc == {"total_events": 0, "by_action": {}, "by_source": {}, "top_countries": [], "top_paths": {}, "top_user_agents": []}


def test_nothing_stored(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert sorted(jobs.analyze(store, str(tmp_path / "log"), AS_OF)) == ["firewall_analysis", "summary"]
    tables = jobs.present(store, str(tmp_path / "log"), AS_OF)
    assert tables["header_cards"].first().data_through == ""
    assert tables["traffic_bars"].count() == tables["persona_cards"].count() == 0


def test_landing_without_some_feeds(spark, tmp_path):
    land(str(tmp_path / "landing"), "firewall", [response(S.FIREWALL_FEED, [{"datetime": "2024-01-01T00:00:00Z", "rayName": "a"}])])
    store = Store(spark, str(tmp_path / "store"))
    assert jobs.collect(store, str(tmp_path / "landing"), AS_OF, "r1")
    assert store.read("firewall_events").count() == 1
    assert feeds.read_landing(spark, str(tmp_path / "landing/firewall")).count() == 1


def test_map_order_survives_json(spark):
    frame = spark.createDataFrame([("b",)] * 3 + [("a",)] * 2 + [("c",)] * 5, "action string").select(
        "action", *(F.lit("x").alias(c) for c in ("source", "country", "request_path", "user_agent")),
        F.lit("2024-01-08T00:00:00Z").alias("event_datetime"),
    )
    log = results.to_log(documents.firewall(frame, AS_OF), "firewall_analysis", AS_OF)
    assert list(json.loads(log.first().result_json)["by_action"]) == ["c", "b", "a"]
    again = results.parsed(log, "firewall_analysis").select(F.posexplode("by_action"))
    assert [r.key for r in again.orderBy("pos").collect()] == ["c", "b", "a"]


def test_a_pull_can_be_bounded(spark, tmp_path):
    make_landing(str(tmp_path / "landing"))
    store = Store(spark, str(tmp_path / "store"))
    as_of = "2024-01-08T12:00:00Z"
    jobs.collect(store, str(tmp_path / "landing"), as_of, "r1", hours_back=25)
    hours = store.read("hourly_traffic").agg(F.min("bucket"), F.max("bucket")).first()
    assert tuple(hours) == ("2024-01-07T12:00:00Z", "2024-01-08T11:00:00Z")
    events = store.read("firewall_events").agg(F.min("event_datetime")).first()[0]
    assert events >= "2024-01-07T13:00:00Z"
    capped = Store(spark, str(tmp_path / "capped"))
    jobs.collect(capped, str(tmp_path / "landing"), as_of, "r1", cap=10)
    assert capped.read("hourly_traffic").count() == 10
    assert capped.read("hourly_traffic").agg(F.max("bucket")).first()[0] == "2024-01-01T02:00:00Z"


def test_presentation_without_any_result(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    tables = jobs.present(store, str(tmp_path / "log"), AS_OF)
    cards = tables["header_cards"].collect()
    assert len(cards) == 1 and (cards[0].total_requests, cards[0].data_points, cards[0].data_through) == ("0", "0", "")
    assert tables["anomaly_header"].first().baseline_mean == "0"
    assert tables["persona_header"].first().rows_trained_on == "0"
    assert [tables[t].count() for t in ("persona_cards", "anomaly_table", "action_shares", "top_countries")] == [0] * 4
    assert tables["results"].where("not has_result").count() == 5


def test_a_repeated_run_time_shows_the_later_analysis(spark, tmp_path, hourly):
    store, log = Store(spark, str(tmp_path / "store")), str(tmp_path / "log")
    for n in (1, 2):
        store.load(f"r{n}", hourly=hourly((f"2024-01-0{n}T00:00:00Z", "US", n)))
        jobs.analyze(store, log, AS_OF)
    newest = results.parsed_or_default(results.latest(results.read_log(spark, log)), "summary").first()
    assert newest.data_rows == 2


def test_unreadable_responses_stop_a_strict_run(spark, tmp_path):
    land(str(tmp_path / "landing"), "details", ["garbage"])
    store = Store(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError, match="1 responses"):
        jobs.collect(store, str(tmp_path / "landing"), AS_OF, "r1", strict=True)
    jobs.collect(store, str(tmp_path / "landing"), AS_OF, "r2")
    assert spark.read.parquet(f"{store.root}/rejected/run_id=r2").first().reason == "not json"


def test_scheduled_runs_load_only_what_is_new(spark, tmp_path):
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")
    make_landing(landing)
    store = Store(spark, str(tmp_path / "store"))
    args = (store, landing, str(tmp_path / "places"), str(tmp_path / "log"), out)
    jobs.scheduled_run(*args, AS_OF, "s1")
    first = store.read("request_details").count()
    jobs.scheduled_run(*args, "2024-01-09T06:00:00Z", "s2")
    assert (first, store.read("request_details").count()) == (1, 1)
    assert store.read("hourly_traffic").count() == 744
    assert results.read_log(spark, str(tmp_path / "log")).count() == 10
    assert spark.read.parquet(f"{out}/header_cards").first().data_points == "744"


def test_models_train_again_with_each_landed_pull_and_not_on_a_replay(spark, tmp_path, monkeypatch):
    landing, place, log = (str(tmp_path / n) for n in ("landing", "place", "log"))
    store = Store(spark, str(tmp_path / "store"))
    make_landing(landing)

    def crash(*_args, **_options):
        raise RuntimeError("lost")

    real = jobs.analyze
    monkeypatch.setattr(jobs, "analyze", crash)
    with pytest.raises(Exception, match="lost"):
        jobs.retrain_on_arrival(store, landing, place, log, AS_OF)
    monkeypatch.setattr(jobs, "analyze", real)
    jobs.retrain_on_arrival(store, landing, place, log, AS_OF)
    assert store.read("request_details").count() == 1
    assert results.read_log(spark, log).count() == 5
    assert jobs.analyze(store, log, AS_OF, seq=0) == []
    jobs.retrain_on_arrival(store, landing, place, log, AS_OF)
    assert results.read_log(spark, log).count() == 5
    assert spark.read.parquet(f"{store.root}/rejected/run_id=batch-00000000").first().reason == "not json"

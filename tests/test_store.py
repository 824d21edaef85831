import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from edgelens.sources.store import Store

LATER = "2024-01-03T00:00:00Z"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_upsert_touches_only_the_dates_of_the_batch(store, hourly):
    store.load("r1", hourly=hourly(("2024-01-01T00:00:00Z", "US", 1), ("2024-01-02T00:00:00Z", "US", 2)))
    store.load("r2", hourly=hourly(("2024-01-02T00:00:00Z", "US", 20), ("2024-01-02T01:00:00Z", "US", 3), collected_at=LATER))
    assert rows_of(store.read("hourly_traffic"), "dt", "bucket", "request_count") == [
        ("2024-01-01", "2024-01-01T00:00:00Z", 1),
        ("2024-01-02", "2024-01-02T00:00:00Z", 20),
        ("2024-01-02", "2024-01-02T01:00:00Z", 3),
    ]


def test_other_dates_keep_their_files(store, hourly):
    store.load("r1", hourly=hourly(("2024-01-01T00:00:00Z", "US", 1), ("2024-01-02T00:00:00Z", "US", 2)))
    before = {f for f in store.read("hourly_traffic").inputFiles() if "dt=2024-01-01" in f}
    store.load("r2", hourly=hourly(("2024-01-02T00:00:00Z", "US", 20)))
    assert before <= set(store.read("hourly_traffic").inputFiles())


def test_loading_a_run_again_changes_nothing(store, hourly, events, details):
    feeds = dict(
        hourly=hourly(("2024-01-01T00:00:00Z", "US", 1), ("2024-01-01T00:00:00Z", None, 1)),
        firewall=events(("2024-01-01T05:00:00Z", "block", "a"), ("2024-01-01T05:00:00Z", "block", None)),
        details=details(("2024-01-01T00:00:00Z", "US", 200, "/", 1)),
    )
    assert store.load("r1", **feeds)
    assert not store.load("r1", **feeds)
    assert [store.read(t).count() for t in ("hourly_traffic", "firewall_events", "request_details")] == [2, 2, 1]


def test_first_write_wins_and_details_append_over_runs(store, events, details):
    for run, collected in (("r1", "2024-01-02T00:00:00Z"), ("r2", LATER)):
        store.load(
            run,
            firewall=events(("2024-01-01T05:00:00Z", run, "a"), ("2024-01-01T06:00:00Z", run, f"own-{run}"), collected_at=collected),
            details=details(("2024-01-01T00:00:00Z", "US", 200, "/", 1), collected_at=collected),
        )
    assert rows_of(store.read("firewall_events"), "action", "ray_name") == [
        ("r1", "a"), ("r1", "own-r1"), ("r2", "own-r2"),
    ]
    assert store.read("request_details").count() == 2


@pytest.mark.parametrize("stop_at", ["_upsert", "_insert", "_done"])
def test_a_load_that_stopped_is_repeated_without_a_trace(store, hourly, events, details, monkeypatch, stop_at):
    store.load("r1", hourly=hourly(("2024-01-01T00:00:00Z", "US", 1), ("2024-01-01T00:00:00Z", None, 5)))
    real = getattr(store, stop_at)

    def lost(*args):
        real(*args)
        raise RuntimeError("lost")

    feeds = dict(
        hourly=hourly(("2024-01-01T00:00:00Z", "US", 9), ("2024-01-01T00:00:00Z", None, 6), collected_at=LATER),
        firewall=events(("2024-01-01T05:00:00Z", "block", "a"), ("2024-01-01T05:00:00Z", "block", None)),
        details=details(("2024-01-01T00:00:00Z", "US", 200, "/", 1)),
    )
    if stop_at != "_done":
        monkeypatch.setattr(store, stop_at, lost)
        with pytest.raises(RuntimeError):
            store.load("r2", **feeds)
        monkeypatch.setattr(store, stop_at, real)
    assert store.load("r2", **feeds)
    assert rows_of(store.read("hourly_traffic"), "country", "request_count") == [("US", 9), (None, 5), (None, 6)]
    assert rows_of(store.read("firewall_events"), "ray_name") == [("a",), (None,)]
    assert store.read("request_details").count() == 1
    assert not store.load("r2", **feeds)


def test_empty_store_and_empty_batch(store, hourly):
    assert store.read("hourly_traffic").count() == 0
    assert not store.load("r1", hourly=hourly(("2024-01-01T00:00:00Z", "US", 1)).where("false"))
    assert not store.repair_hourly("fix")


def test_since_reads_only_newer_dates(store, hourly):
    store.load("r1", hourly=hourly(*((f"2024-01-{d:02d}T00:00:00Z", "US", d) for d in range(1, 11))))
    recent = store.read("hourly_traffic", since="2024-01-08")
    assert rows_of(recent, "request_count") == [(10,), (8,), (9,)]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt#" in plan


def test_repair(store, hourly):
    dirty = hourly(
        ("2024-01-01T00:00:00Z", "US", 1),
        ("2024-01-01T00:00:00Z", "US", 2, {"http_method": None}),
        ("2024-01-02T00:00:00Z", "US", 3),
    )
    store.load("r1", hourly=dirty)
    assert store.repair_hourly()
    assert rows_of(store.read("hourly_traffic"), "request_count") == [(1,), (3,)]
    assert not store.repair_hourly()


def _rows_scanned(df):
    """Rows that the scans of a frame handed on, after row groups were left out."""
    df.collect()

    def walk(node):
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(node.plan())
        rows = 0
        if "FileSourceScan" in node.getClass().getSimpleName():
            rows = node.metrics().apply("numOutputRows").value()
        children = node.children()
        return rows + sum(walk(children.apply(i)) for i in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_few_ids_open_few_row_groups(store, events):
    """Ids of all loads lie in one range; the Bloom filters tell the loads apart."""
    for run in range(6):
        store.load(f"r{run}", firewall=events(*(("2024-01-01T05:00:00Z", "x", f"id-{i * 6 + run:05d}") for i in range(200))))
    stored = store.read("firewall_events")
    assert stored.count() == 1200
    batch = events(("2024-01-02T00:00:00Z", "y", "id-00302"), ("2024-01-02T00:00:00Z", "y", "new"))
    met = store.probed(stored, batch)
    assert _rows_scanned(met.select("ray_name")) == 200
    assert rows_of(met, "ray_name") == [("id-00302",)]
    store.load("late", firewall=batch)
    assert store.read("firewall_events").where("action = 'y'").count() == 1


def test_many_ids_are_joined(store, events, monkeypatch):
    from edgelens.sources import store as module

    monkeypatch.setattr(module, "PROBE_IDS", 3)
    store.load("r1", firewall=events(*(("2024-01-01T05:00:00Z", "x", f"r{i}") for i in range(50))))
    stored = store.read("firewall_events")
    batch = events(*(("2024-01-02T00:00:00Z", "y", f"r{i}") for i in range(45, 55)))
    assert store.probed(stored, batch) is stored
    store.load("r2", firewall=batch)
    assert rows_of(store.read("firewall_events").where("action = 'y'"), "ray_name") == [(f"r{i}",) for i in range(50, 55)]


def test_event_text_without_a_date_still_loads(store, events):
    store.load("r1", firewall=events(("", "x", "a")))
    assert store.read("firewall_events").where(F.col("event_datetime") == "").count() == 1


def test_the_run_written_last_wins_whatever_its_time(store, hourly):
    hour = "2024-01-01T00:00:00Z"
    store.load("r1", hourly=hourly((hour, "US", 10, {"ingest_seq": 9})))
    store.load("r2", hourly=hourly((hour, "US", 20, {"ingest_seq": 0})))
    assert rows_of(store.read("hourly_traffic"), "request_count") == [(20,)]
    store.load("r3", hourly=hourly((hour, "US", 30), collected_at="2023-12-01T00:00:00Z"))
    assert rows_of(store.read("hourly_traffic"), "request_count", "arrival.run_seq") == [(30, 2)]


def test_repair_keeps_the_earliest_run_and_can_run_again(store, hourly):
    hour = "2024-01-01T00:00:00Z"
    for run, requests, number in (("r1", 6, 5), ("r2", 12, 0)):
        store.load(run, hourly=hourly((hour, "US", requests, {"http_method": None, "ingest_seq": number})))
    assert store.repair_hourly()
    assert rows_of(store.read("hourly_traffic"), "request_count", "http_method") == [(6, "")]
    assert not store.repair_hourly()
    store.load("r3", hourly=hourly((hour, None, 4)))
    assert store.repair_hourly()
    assert rows_of(store.read("hourly_traffic"), "country", "request_count") == [("US", 6), ("Unknown", 4)]


def test_nothing_is_left_of_batches(spark, store, hourly, details):
    from edgelens.session import shared_folder

    batches = lambda: [p.getPath().getName() for p in _listed(spark, shared_folder(spark)) if "batch" in p.getPath().getName()]
    before = batches()
    for i in range(3):
        store.load(
            f"r{i}",
            hourly=hourly(("2024-01-01T00:00:00Z", "US", i)),
            details=details(("2024-01-01T00:00:00Z", "US", 200, "/", i)),
        )
    assert batches() == before
    assert rows_of(store.read("hourly_traffic"), "request_count") == [(2,)]
    assert store.read("request_details").count() == 3


def _listed(spark, folder):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)

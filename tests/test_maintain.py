from conftest import rows_of
from edgelens.operators import maintain as R

LATER = "2024-01-02T00:00:00Z"


def test_upsert_last_write_wins(hourly):
    stored = hourly(("b1", "US", 1), ("b1", "DE", 2), ("b1", None, 3))
    batch = hourly(("b1", "US", 10), ("b1", "US", 11), ("b1", None, 4), ("b2", "US", None), collected_at=LATER)
    merged = R.upsert_hourly(stored, batch)
    assert rows_of(merged, "bucket", "country", "request_count") == [
        ("b1", "DE", 2),
        ("b1", "US", 11),
        ("b1", None, 3),
        ("b1", None, 4),
        ("b2", "US", 0),
    ]


def test_upsert_twice_changes_nothing_on_whole_keys(hourly):
    stored = hourly(("b1", "US", 1), ("b1", "DE", 2))
    batch = hourly(("b1", "US", 10), ("b2", "US", 5), collected_at=LATER)
    once = R.upsert_hourly(stored, batch)
    assert rows_of(R.upsert_hourly(once, batch)) == rows_of(once)


def test_upsert_tells_method_and_status_apart(hourly):
    batch = hourly(("b1", "US", 1, {"http_method": "GET"}), ("b1", "US", 2, {"status_code": 404}))
    assert R.upsert_hourly(hourly(("b1", "US", 9)), batch).count() == 3


def test_first_write_wins(events):
    stored = events(("t1", "block", "a"), ("t1", "block", ""), ("t1", "block", None))
    batch = events(
        ("t2", "late", "a"), ("t2", "new", "b"), ("t3", "newer", "b"), ("t2", "late", ""),
        ("t2", "late", None), (None, "dropped", "c"), collected_at=LATER,
    )
    assert rows_of(R.insert_events(stored, batch), "event_datetime", "action", "ray_name") == [
        ("t1", "block", ""),
        ("t1", "block", "a"),
        ("t1", "block", None),
        ("t2", "late", None),
        ("t2", "new", "b"),
    ]


def test_first_write_wins_in_any_split(events):
    rows = [(f"t{i}", f"a{i}", f"r{i % 4}") for i in range(12)]
    whole = rows_of(R.first_write_wins(events(*rows)), "event_datetime", "ray_name")
    for cut in (1, 3, 7):
        first = R.first_write_wins(events(*rows[:cut]))
        split = R.insert_events(first, events(*rows[cut:], collected_at=LATER))
        assert rows_of(split, "event_datetime", "ray_name") == whole


def test_keep_first_reads_null_as_default(hourly):
    null = {"http_method": None, "status_code": None}
    ht = hourly(
        ("b1", "US", 1), ("b1", "US", 2, null), ("b1", None, 3), ("b1", "", 4), ("b2", None, 5, null)
    )
    assert rows_of(R.keep_first(ht), "bucket", "country", "request_count") == [
        ("b1", "US", 1),
        ("b1", None, 3),
        ("b2", None, 5),
    ]
    assert rows_of(R.duplicate_keys(ht)) == [("b1", "", "", 0, 2), ("b1", "US", "", 0, 2)]


def test_fill_null_dims(hourly):
    ht = hourly(("b1", None, 1, {"http_method": None, "status_code": None, "content_type": None}), ("b1", "US", 2))
    assert R.null_dims(ht).count() == 1
    filled = R.fill_null_dims(ht)
    assert R.null_dims(filled).count() == 0
    assert rows_of(filled, "country", "http_method", "status_code", "content_type", "request_count") == [
        ("US", "", 0, "", 2),
        ("Unknown", "", 0, "", 1),
    ]


def test_repair_leaves_a_unique_key(hourly):
    ht = hourly(("b1", None, 1), ("b1", "Unknown", 2), ("b1", "Unknown", 3, {"status_code": None}))
    repaired = R.repair(ht)
    assert R.duplicate_keys(repaired).count() == 0
    # NULL method reads as the default: 3 repeats 2 and goes. The row without country
    # becomes Unknown too, and its requests are added.
    assert rows_of(repaired, "country", "request_count") == [("Unknown", 3)]
    assert rows_of(R.repair(repaired)) == rows_of(repaired)


def test_append_keeps_everything_unless_asked(details):
    first = details(("b1", "US", 200, "/", 1), ("b1", "US", None, "/", 2))
    again = details(("b1", "US", 200, "/", 5), ("b1", "US", None, "/", 6), collected_at=LATER)
    assert R.append_details(first, again).count() == 4
    assert rows_of(R.append_details(first, again, dedupe=True), "status_code", "request_count") == [
        (200, 5),
        (None, 6),
    ]

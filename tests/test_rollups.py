import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from edgelens.operators import breakdown, rollups, windows


def test_rollup_counts_null_countries_in_sums_only(hourly):
    ht = hourly(("b1", "US", 1), ("b1", None, 2), ("b2", None, 4))
    assert rows_of(rollups.by_bucket(ht), "bucket", "total_requests", "unique_countries") == [
        ("b1", 3, 1),
        ("b2", 4, 0),
    ]


def test_country_distribution_ties_cut_and_totals(hourly):
    rows = [("b1", f"C{i:02d}", 10 if i < 58 else 20) for i in range(60)]
    ht = hourly(*rows, ("b1", None, 999))
    top = rollups.country_distribution(ht).collect()
    assert [r.country for r in top] == ["C58", "C59"] + [f"C{i:02d}" for i in range(48)]
    assert {(r.total_countries, r.total_requests) for r in top} == {(60, 620)}
    assert top[0].pct == 3.23 and top[2].pct == 1.61


def test_country_distribution_of_nothing(hourly):
    assert rollups.country_distribution(hourly(("b1", None, 5))).count() == 0


def test_zero_requests_do_not_divide(hourly):
    row = rollups.country_distribution(hourly(("b1", "US", 0, {"threats": 3}))).first()
    assert (row.pct, row.threat_pct) == (0.0, 300.0)


def test_threat_countries_keep_request_order(hourly):
    ht = hourly(*(("b", f"C{i}", 100 - i, {"threats": i % 2 * (i + 1)}) for i in range(30)))
    top = rollups.threat_countries(rollups.country_distribution(ht)).collect()
    assert [r.country for r in top] == [f"C{i}" for i in range(1, 17, 2)]


def test_summary_of_empty_tables(hourly, events):
    ht, fe = hourly(("b", "US", 1)).where("false"), events(("t", "a", "r")).where("false")
    row = rollups.summary(ht, fe).first()
    assert row.asDict() == {
        "data_rows": 0,
        "earliest_data": None,
        "latest_data": None,
        "total_requests": 0,
        "total_bytes": 0,
        "total_threats": 0,
        "unique_countries": 0,
        "firewall_events": 0,
    }


@pytest.mark.parametrize("n", [1, 2])
def test_baseline_of_few_hours(spark, n):
    hours = spark.createDataFrame([(f"b{i}", 10 * (i + 1)) for i in range(n)], "bucket string, total_requests bigint")
    row = rollups.baseline(hours).first()
    assert row.baseline_std_requests == pytest.approx(0.0 if n == 1 else np.std([10, 20], ddof=1))


@pytest.mark.parametrize(
    "values",
    [
        [7],
        [3, 3, 3],
        [1, 2],
        [5, 1, 4, 2, 3],
        [0] * 50 + [10**12],
        [-5, -1, 0, 8, 8, 8, 9, 10**6],
        list(np.random.default_rng(1).integers(-1000, 10**7, 500)),
        list(np.random.default_rng(2).zipf(1.5, 400).clip(max=10**9)),
    ],
)
def test_quantiles_are_exact(spark, values):
    frame = spark.createDataFrame([(int(v),) for v in values], "v bigint")
    got = rollups.exact_quantiles(frame, "v", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    assert list(got) == pytest.approx(list(np.quantile(values, [0.0, 0.25, 0.5, 0.9, 1.0])))


def test_quantiles_with_weights_nulls_and_nothing(spark):
    frame = spark.createDataFrame([(1, 3), (5, 1), (None, 9)], "v int, w int")
    assert list(rollups.exact_quantiles(frame, "v", [0.5, 0.9], "w").first()) == pytest.approx(
        list(np.quantile([1, 1, 1, 5], [0.5, 0.9]))
    )
    assert list(rollups.exact_quantiles(frame.where("false"), "v", [0.5], "w").first()) == [None]


def test_value_counts_order_and_null(spark):
    frame = spark.createDataFrame([(c,) for c in ["b", "a", "c", "c", None, "b", "a"]], "x string")
    assert [tuple(r) for r in breakdown.value_counts(frame, "x").collect()] == [("a", 2), ("b", 2), ("c", 2)]
    assert [r.x for r in breakdown.value_counts(frame, "x", 2).collect()] == ["a", "b"]


def test_breakdown_limits_match_value_counts(spark):
    data = [(f"a{i % 30}", f"s{i % 17}", f"c{i % 12}", f"/p{i % 40}", f"u{i % 11}") for i in range(500)]
    frame = spark.createDataFrame(data, "action string, source string, country string, request_path string, user_agent string")
    lists = breakdown.breakdown(frame)
    for column, top in breakdown.BREAKDOWN_LIMITS.items():
        got = lists.where(F.col("dimension") == column).orderBy("position").select("value", "count").collect()
        want = breakdown.value_counts(frame, column, top).collect()
        assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_windows(hourly, events):
    as_of = "2024-01-08T00:00:00Z"
    ht = hourly(("2023-12-31T23:59:59Z", "A", 1), ("2024-01-01T00:00:00Z", "A", 2), ("2024-01-09T00:00:00Z", "A", 3))
    assert rows_of(windows.rolling_window(ht, "bucket", as_of), "request_count") == [(2,), (3,)]
    fe = events(("2024-01-07T00:00:00Z", "a", "1"), ("2024-01-07T00:00:01Z", "a", "2"), ("2024-01-08T00:00:00Z", "a", "3"))
    assert rows_of(windows.open_interval(fe, "event_datetime", as_of, 48, cap=24), "ray_name") == [("2",)]
    assert windows.open_interval(fe, "event_datetime", as_of, 48).count() == 2


@pytest.mark.parametrize("n, passes", [(4, 0), (5, 5), (6, 6)])
def test_gate(spark, n, passes):
    assert windows.at_least(spark.range(n)).count() == passes


def test_cap_is_off_by_default(spark):
    assert windows.cap_rows(spark.range(9), None, F.asc("id")).count() == 9
    assert rows_of(windows.cap_rows(spark.range(9), 2, F.desc("id"))) == [(7,), (8,)]

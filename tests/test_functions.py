from datetime import datetime, timedelta, timezone
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from edgelens.functions import numeric as N
from edgelens.functions import timetext as T


def one(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "text, shown",
    [
        ("2026-03-18T22:00:00Z", "Mar 18, 10:00 PM UTC"),
        ("2026-03-08T00:05:00Z", "Mar 8, 12:05 AM UTC"),
        ("2026-12-01T12:00:00Z", "Dec 1, 12:00 PM UTC"),
        ("yesterday", "yesterday"),
        ("2026-13-01T00:00:00Z", "2026-13-01T00:00:00Z"),
        ("", ""),
        (None, None),
    ],
)
def test_display(spark, text, shown):
    assert one(spark, T.display(F.lit(text).cast("string"))) == shown


def test_axis_label(spark):
    assert one(spark, T.axis_label(F.lit("2026-03-18T22:00:00Z"))) == "Mar 18, 10PM"
    assert one(spark, T.axis_label(F.lit("2026-03-18T00:00:00Z"))) == "Mar 18, 12AM"


def test_cutoff_takes_text_datetime_and_column(spark):
    naive = datetime(2024, 1, 30, 23, 57, 12)
    zoned = datetime(2024, 1, 31, 1, 57, 12, tzinfo=timezone(timedelta(hours=2)))
    column = F.lit("2024-01-30 23:57:12.5").cast("timestamp_ntz")
    for as_of in (naive, zoned, "2024-01-30T23:57:12Z", "2024-01-30T23:57:12", column):
        assert one(spark, T.cutoff(as_of, days=7)) == "2024-01-23T23:57:12Z"
        assert one(spark, T.cutoff(as_of, hours=25)) == "2024-01-29T22:57:12Z"


def test_text_does_not_follow_the_session_zone(spark):
    ts = F.lit("2024-03-10 02:30:15").cast("timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert one(spark, T.iso_second(ts)) == "2024-03-10T02:30:15Z"
        assert one(spark, T.iso_hour(ts)) == "2024-03-10T02:00:00Z"
        assert one(spark, T.iso_from(*T.day_and_hour(ts))) == "2024-03-10T02:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hour_of_iso(spark):
    assert one(spark, T.hour_of_iso(F.lit("2024-01-16T23:17:42Z"))) == "2024-01-16T23:00:00Z"


@pytest.mark.parametrize(
    "part, whole", [(0, 0), (5, 0), (1, 3), (2, 3), (1005, 100000), (1, 200), (10**17, 3 * 10**17), (7, 2)]
)
def test_percent_is_exact_half_up(spark, part, whole):
    exact = Decimal(part) * 100 / Decimal(max(whole, 1))
    p, w = F.lit(part).cast("bigint"), F.lit(whole).cast("bigint")
    two = exact.quantize(Decimal("0.01"), ROUND_HALF_UP)
    four = exact.quantize(Decimal("0.0001"), ROUND_HALF_UP)
    assert one(spark, N.share_pct(p, w)) == float(two)
    assert one(spark, N.threat_pct(p, w)) == float(four)


@pytest.mark.parametrize("rows, k", [(0, 2), (5, 2), (59, 2), (60, 3), (119, 5), (120, 6), (10**9, 6)])
def test_cluster_count(spark, rows, k):
    assert one(spark, N.cluster_count(F.lit(rows))) == k


@pytest.mark.parametrize("n, rate", [(0, 0.1), (5, 0.1), (20, 0.1), (21, 2 / 21), (169, 2 / 169)])
def test_contamination(spark, n, rate):
    assert one(spark, N.contamination(F.lit(n))) == rate


def test_presentation_numbers(spark):
    assert one(spark, N.thousands(F.lit(1234567))) == "1,234,567"
    assert one(spark, N.bubble_radius(F.lit(1))) == 6.0
    assert one(spark, N.bubble_radius(F.lit(100))) == 30.0
    assert [one(spark, N.palette_index(F.lit(i))) for i in (0, 7, 8, 9)] == [0, 7, 0, 1]
    assert one(spark, N.severity(F.lit(0.2), F.lit(500.0))) == "red"
    assert one(spark, N.severity(F.lit(0.1), F.lit(100.5))) == "green"
    assert one(spark, N.severity(F.lit(0.1), F.lit(100.0))) == "blue"
    assert one(spark, N.ratio(F.lit(5), F.lit(0))) == 5.0


@pytest.mark.parametrize("x", [25.15, 1.25, 0.05, 249.25, 1234567.06, -0.04375, 0.0])
def test_fixed_point_text_rounds_like_printf(spark, x):
    assert one(spark, N.fixed(F.lit(x), 1)) == "%.1f" % x
    assert one(spark, N.fixed(F.lit(x), 4)) == "%.4f" % x

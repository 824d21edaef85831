"""Guarded arithmetic and presentation numbers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def at_least_one(x: Column) -> Column:
    """Divisor guard."""
    return F.greatest(x, F.lit(1))


def _half_up(numerator: Column, divisor: Column, scale: int) -> Column:
    """``round(numerator / divisor * 100, scale)`` on integers, exactly half-up.

    Works in decimal so that neither engine nor sum size changes a digit.
    """
    d = at_least_one(divisor).cast("decimal(20,0)")
    n = numerator.cast("decimal(20,0)")
    factor = F.lit(2 * 100 * 10**scale).cast("decimal(8,0)")
    quotient = F.call_function("div", n * factor + d, d * F.lit(2).cast("decimal(1,0)"))
    return quotient / F.lit(float(10**scale))


def share_pct(part: Column, total: Column) -> Column:
    """Percent of a total, 2 digits."""
    return _half_up(part, total, 2)


def threat_pct(threats: Column, requests: Column) -> Column:
    """Threats in percent of requests, 4 digits."""
    return _half_up(threats, requests, 4)


def ratio(part: Column, whole: Column) -> Column:
    """Fraction with the divisor guard."""
    return part / at_least_one(whole)


def cluster_count(rows: Column) -> Column:
    """Number of clusters for a row count: one per twenty rows, from 2 to 6."""
    return F.least(F.greatest(F.lit(2), F.floor(rows / 20)), F.lit(6)).cast("int")


def contamination(buckets: Column) -> Column:
    """Expected share of outliers: two buckets, a tenth at most."""
    return F.least(F.lit(0.1), F.lit(2.0) / at_least_one(buckets))


def megabytes(n: Column) -> Column:
    return n / F.lit(1024) / F.lit(1024)


def bubble_radius(size: Column) -> Column:
    return F.greatest(F.sqrt(size) * F.lit(3), F.lit(6.0))


def palette_index(position: Column) -> Column:
    return F.pmod(position, F.lit(8)).cast("int")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def fixed(x: Column, digits: int) -> Column:
    """Fixed-point text, rounded half-even on the exact binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x, F.lit(pattern))


def severity(threat_ratio: Column, avg_requests: Column) -> Column:
    """Icon class of a persona card."""
    return (
        F.when(threat_ratio > 0.1, "red").when(avg_requests > 100, "green").otherwise("blue")
    )


def bar_colour(is_anomaly: Column) -> Column:
    return F.when(is_anomaly, "red").otherwise("blue")

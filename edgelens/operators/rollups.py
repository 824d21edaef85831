"""Sums by hour and by country, all-time totals, exact quantiles."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from edgelens.functions import numeric as N
from edgelens.functions import timetext as T
from edgelens.session import checkpoint

TOP_COUNTRIES = 50


def _sums() -> list[Column]:
    return [
        F.sum("request_count").alias("total_requests"),
        F.sum("bytes_total").alias("total_bytes"),
        F.sum("threats").alias("total_threats"),
    ]


def by_bucket(ht: DataFrame) -> DataFrame:
    """Hourly totals and number of countries; NULL countries count in the sums only."""
    return ht.groupBy("bucket").agg(
        *_sums(), F.countDistinct("country").alias("unique_countries")
    )


def request_series(ht: DataFrame) -> DataFrame:
    return ht.groupBy("bucket").agg(F.sum("request_count").alias("total_requests"))


def by_country(ht: DataFrame) -> DataFrame:
    return ht.where(F.col("country").isNotNull()).groupBy("country").agg(*_sums())


def country_distribution(ht: DataFrame, top: int = TOP_COUNTRIES) -> DataFrame:
    """The largest countries with their share of everything.

    The totals are a scalar subquery over the grouped rows; it asks for the same
    columns as the list, so one aggregation (and one shuffle) serves both.
    """
    grouped = by_country(ht)
    totals = grouped.agg(
        F.struct(
            F.count(F.lit(1)).alias("countries"),
            F.sum("total_requests").alias("requests"),
            F.sum("total_bytes").alias("bytes"),
            F.sum("total_threats").alias("threats"),
        )
    ).scalar()
    largest = grouped.orderBy(F.desc("total_requests"), "country").limit(top)
    return largest.select(
        "country",
        F.col("total_requests").alias("requests"),
        F.col("total_bytes").alias("bytes"),
        F.col("total_threats").alias("threats"),
        N.share_pct(F.col("total_requests"), totals.getField("requests")).alias("pct"),
        N.threat_pct(F.col("total_threats"), F.col("total_requests")).alias("threat_pct"),
        totals.getField("countries").alias("total_countries"),
        totals.getField("requests").alias("total_requests"),
    )


def threat_countries(distribution: DataFrame, top: int = 8) -> DataFrame:
    """First countries with any threat, still in request order."""
    return (
        distribution.where(F.col("threat_pct") > 0)
        .orderBy(F.desc("requests"), "country")
        .limit(top)
        .select("country", "requests", "threat_pct")
    )


def summary(ht: DataFrame, fe: DataFrame) -> DataFrame:
    """One row of all-time totals; zeros on empty tables."""

    def total(col: str, name: str) -> Column:
        return F.coalesce(F.sum(col), F.lit(0)).cast("bigint").alias(name)

    return ht.agg(
        F.count(F.lit(1)).alias("data_rows"),
        F.min("bucket").alias("earliest_data"),
        F.max("bucket").alias("latest_data"),
        total("request_count", "total_requests"),
        total("bytes_total", "total_bytes"),
        total("threats", "total_threats"),
        F.countDistinct("country").alias("unique_countries"),
    ).withColumn("firewall_events", fe.agg(F.count(F.lit(1))).scalar())


def baseline(hours: DataFrame) -> DataFrame:
    """Number of hours, expected outlier share, mean and sample deviation of requests."""
    return hours.agg(
        F.count(F.lit(1)).alias("total_buckets_analyzed"),
        N.contamination(F.count(F.lit(1))).alias("contamination_rate"),
        F.try_divide(F.sum("total_requests"), F.count("total_requests")).alias("baseline_mean_requests"),
        F.coalesce(F.stddev_samp("total_requests"), F.lit(0.0)).alias("baseline_std_requests"),
    )


def sliding_totals(ht: DataFrame, days: int = 7, step_hours: int = 6) -> DataFrame:
    """Totals of every ``days`` window that starts on a ``step_hours`` mark.

    Rows first combine per step; only those few steps fan out to their windows.
    """
    start = F.to_timestamp_ntz("bucket", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    step = F.window(start, f"{step_hours} hours")
    slots = (
        ht.groupBy(step.alias("step"))
        .agg(F.sum("request_count").alias("requests"), F.sum("threats").alias("threats"))
        .select(F.col("step.start").alias("at"), "requests", "threats")
    )
    return (
        slots.groupBy(F.window("at", f"{days} days", f"{step_hours} hours").alias("w"))
        .agg(F.sum("requests").alias("total_requests"), F.sum("threats").alias("total_threats"))
        .select(
            T.iso_second(F.col("w.start")).alias("window_start"),
            T.iso_second(F.col("w.end")).alias("window_end"),
            "total_requests",
            "total_threats",
        )
    )


def exact_quantiles(
    df: DataFrame, column: str, probabilities: list[float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles of an integer column, one row.

    Rows collapse to (value, count) pairs, which are kept; only their extent comes
    to the driver. The value range is cut into cells, about as many as values fit
    in one. Running counts are kept within a cell and across cells, so neither the
    sort of a cell nor the list of cells is longer than the root of the range.
    """
    names = [f"q{round(p * 100)}" for p in probabilities]
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = checkpoint(
        df.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("v"))
        .agg(n.cast("bigint").alias("n"))
    )
    low, high, total = counts.agg(F.min("v"), F.max("v"), F.sum("n")).first()
    if not total:
        return counts.agg(*(F.max("v").cast("double").alias(name) for name in names))
    width = math.isqrt(high - low) + 1
    ranks = [p * (total - 1) for p in probabilities]
    places = sorted({edge(rank) for rank in ranks for edge in (math.floor, math.ceil)})

    def so_far(window: Window) -> Column:
        ahead = window.rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(ahead), F.lit(0))

    def holds(place: int) -> Column:
        return (F.col("before") <= place) & (place < F.col("before") + F.col("n"))

    celled = counts.withColumn("cell", F.call_function("div", F.col("v") - low, F.lit(width)))
    cells = (
        celled.groupBy("cell")
        .agg(F.sum("n").alias("n"))
        .withColumn("before", so_far(Window.orderBy("cell")))
        .where(reduce(lambda a, b: a | b, map(holds, places)))
        .select("cell", F.col("before").alias("cell_before"))
    )
    found = (
        celled.join(cells, "cell")
        .withColumn("before", F.col("cell_before") + so_far(Window.partitionBy("cell").orderBy("v")))
        .agg(*(F.max(F.when(holds(place), F.col("v"))).alias(f"at_{place}") for place in places))
    )

    def between(rank: float) -> Column:
        below, above = F.col(f"at_{math.floor(rank)}"), F.col(f"at_{math.ceil(rank)}")
        return below + (above - below) * F.lit(rank - math.floor(rank))

    return found.select(*(between(r).alias(name) for r, name in zip(ranks, names)))


# Size of a quantile sketch; its ranks are off by about 0.2 % of the rows.
SKETCH_K = 1600


def quantile_sketches(df: DataFrame, column: str, by: Column) -> DataFrame:
    """One mergeable sketch of an integer column per date: ``dt``, ``sketch``.

    Sketches are a few kilobytes whatever a date holds. A run writes those of the dates
    it touched and merges all, so no run reads the history's rows again.
    """
    return df.groupBy(by.alias("dt")).agg(F.kll_sketch_agg_bigint(column, F.lit(SKETCH_K)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probabilities: list[float]) -> DataFrame:
    """Approximate quantiles of all rows that the sketches cover, one row; null without rows."""
    merged = sketches.agg(F.kll_merge_agg_bigint("sketch").alias("s"))
    names, n = [f"q{round(p * 100)}" for p in probabilities], F.kll_sketch_get_n_bigint("s")
    return merged.select(
        n.alias("n"),
        *(F.when(n > 0, F.kll_sketch_get_quantile_bigint("s", F.lit(p))).alias(c) for p, c in zip(probabilities, names)),
    )

"""The five analyses as one typed document each.

Every function returns a frame of one row with the fields of its document, or
nothing where the analysis has nothing to say. Lists are collected only after a
limit or an aggregation: countries (50 at most), clusters, ranked values, hours
flagged as anomalous.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from edgelens.functions import numeric as N
from edgelens.operators import breakdown as B
from edgelens.operators import forest, personas, rollups
from edgelens.operators.windows import MIN_ROWS, rolling_window


def _ordered(entry: Column, *order: Column, only: Column | None = None) -> Column:
    """Collect ``entry`` sorted by ``order``, from the rows where ``only`` holds."""
    keyed = F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order)), entry.alias("_e"))
    if only is not None:
        keyed = F.when(only, keyed)
    return F.transform(F.array_sort(F.collect_list(keyed)), lambda e: e["_e"])


def summary(ht: DataFrame, fe: DataFrame) -> DataFrame:
    return rollups.summary(ht, fe)


def geo(ht: DataFrame) -> DataFrame:
    entry = F.struct(
        "country", "requests", "bytes", "threats", "pct", F.col("threat_pct").alias("threat_ratio")
    )
    return (
        rollups.country_distribution(ht)
        .groupBy("total_countries", "total_requests")
        .agg(_ordered(entry, -F.col("requests"), F.col("country")).alias("countries"))
    )


def firewall(fe: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Event breakdown of the rolling window; empty lists when it holds no event."""
    recent = rolling_window(fe, "event_datetime", as_of)

    def entries(dimension: str, name: str) -> Column:
        entry = F.struct(F.col("value").alias(name), F.col("count"))
        return _ordered(entry, F.col("position"), only=F.col("dimension") == dimension)

    return B.breakdown(recent).agg(
        F.coalesce(F.max(F.when(F.col("dimension") == B.TOTAL, F.col("count"))), F.lit(0)).alias("total_events"),
        F.map_from_entries(entries("action", "value")).alias("by_action"),
        F.map_from_entries(entries("source", "value")).alias("by_source"),
        entries("country", "country").alias("top_countries"),
        F.map_from_entries(entries("request_path", "value")).alias("top_paths"),
        entries("user_agent", "ua").alias("top_user_agents"),
    )


def persona_document(
    labelled: DataFrame, n_clusters: Column, rows: Column, inertia: Column
) -> DataFrame:
    """Document of named profiles, from a fit or from a given assignment."""
    entry = F.struct(
        F.col("cluster").alias("cluster_id"),
        "size",
        "avg_requests",
        "avg_bytes",
        "total_threats",
        "top_countries",
        "threat_ratio",
        "label",
    )
    with_map = F.transform(
        _ordered(entry, F.col("rank")),
        lambda p: p.withField("top_countries", F.map_from_entries(p["top_countries"])),
    )
    return labelled.agg(with_map.alias("profiles")).select(
        n_clusters.alias("n_clusters"),
        rows.alias("total_rows_analyzed"),
        inertia.alias("inertia"),
        "profiles",
    )


def persona(ht: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame | None:
    """Cluster profiles of all history; nothing below ``min_rows`` rows."""
    fitted = personas.fit(ht, min_rows)
    if fitted is None:
        return None
    return persona_document(
        personas.labelled_profiles(fitted.points, "weight"),
        F.lit(fitted.n_clusters),
        F.lit(fitted.rows).cast("bigint"),
        F.lit(fitted.inertia),
    )


def anomaly(
    ht: DataFrame, as_of: datetime | str | Column, min_rows: int = MIN_ROWS
) -> DataFrame | None:
    """Flagged hours of the rolling window; nothing below ``min_rows`` hours."""
    recent = rollups.by_bucket(rolling_window(ht, "bucket", as_of))
    flagged = forest.detect(recent, min_rows=min_rows)
    if flagged is None:
        return None
    entry = F.struct("bucket", *forest.FEATURES, "anomaly_score")
    return flagged.agg(
        F.count(F.lit(1)).alias("total_buckets_analyzed"),
        F.count_if("is_anomaly").alias("anomalies_found"),
        N.contamination(F.count(F.lit(1))).alias("contamination_rate"),
        F.avg("total_requests").alias("baseline_mean_requests"),
        F.coalesce(F.stddev_samp("total_requests"), F.lit(0.0)).alias("baseline_std_requests"),
        _ordered(entry, F.col("bucket"), only=F.col("is_anomaly")).alias("anomalies"),
    )

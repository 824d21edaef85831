"""Chart series and cards: small tables for a BI tool, from results and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from edgelens.functions import numeric as N
from edgelens.functions import timetext as T
from edgelens.operators import rollups


def header_cards(summary: DataFrame) -> DataFrame:
    return summary.select(
        N.thousands(F.col("total_requests")).alias("total_requests"),
        F.col("unique_countries"),
        N.thousands(F.col("total_threats")).alias("threats_detected"),
        N.thousands(F.col("firewall_events")).alias("firewall_events"),
        N.thousands(F.col("data_rows")).alias("data_points"),
        F.coalesce(T.display(F.col("latest_data")), F.lit("")).alias("data_through"),
        F.coalesce(T.display(F.col("earliest_data")), F.lit("")).alias("data_from"),
    )


def traffic_bars(series: DataFrame, marked: DataFrame) -> DataFrame:
    """Request series with a mark on the given buckets.

    ``marked`` is one row per flagged hour; the join strategy follows its size.
    """
    marks = marked.select("bucket").distinct().withColumn("hit", F.lit(True))
    flag = F.coalesce("hit", F.lit(False))
    return series.join(marks, "bucket", "left").select(
        "bucket",
        T.axis_label(F.col("bucket")).alias("axis_label"),
        "total_requests",
        flag.alias("is_anomaly"),
        N.bar_colour(flag).alias("colour"),
    )


def top_countries(distribution: DataFrame, top: int = 10) -> DataFrame:
    return (
        distribution.orderBy(F.desc("requests"), "country")
        .limit(top)
        .select("country", "requests", "pct")
    )


def threat_bars(distribution: DataFrame) -> DataFrame:
    return rollups.threat_countries(distribution)


def persona_cards(labelled: DataFrame) -> DataFrame:
    names = F.transform("top_countries", lambda c: c["country"])
    return labelled.select(
        "rank",
        "label",
        N.severity(F.col("threat_ratio"), F.col("avg_requests")).alias("icon"),
        "size",
        N.fixed(F.col("avg_requests"), 1).alias("avg_requests"),
        "total_threats",
        F.array_join(names, ", ").alias("countries"),
    )


def persona_bubbles(labelled: DataFrame) -> DataFrame:
    return labelled.select(
        "rank",
        "label",
        F.col("avg_requests").alias("x"),
        F.col("total_threats").alias("y"),
        N.bubble_radius(F.col("size")).alias("radius"),
        N.palette_index(F.col("rank")).alias("colour_index"),
    )


def persona_header(persona_doc: DataFrame) -> DataFrame:
    """Clusters and rows behind the persona cards."""
    return persona_doc.select("n_clusters", N.thousands(F.col("total_rows_analyzed")).alias("rows_trained_on"))


def anomaly_header(anomaly_doc: DataFrame) -> DataFrame:
    """What the anomaly table was found in."""
    return anomaly_doc.select(
        "total_buckets_analyzed",
        "anomalies_found",
        N.fixed(F.col("baseline_mean_requests"), 0).alias("baseline_mean"),
        N.fixed(F.col("baseline_std_requests"), 0).alias("baseline_std"),
    )


def anomaly_table(anomalies: DataFrame) -> DataFrame:
    return anomalies.select(
        "bucket",
        T.display(F.col("bucket")).alias("time_bucket"),
        N.thousands(F.col("total_requests")).alias("requests"),
        F.concat(N.fixed(N.megabytes(F.col("total_bytes")), 1), F.lit(" MB")).alias("bandwidth"),
        F.col("total_threats").alias("threats"),
        F.col("unique_countries").alias("countries"),
        N.fixed(F.col("anomaly_score"), 4).alias("score"),
    )


def action_shares(firewall_doc: DataFrame) -> DataFrame:
    """Firewall actions in stored order, from the newest event breakdown."""
    return firewall_doc.select(F.posexplode("by_action").alias("position", "action", "count"))

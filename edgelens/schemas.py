"""Declared schemas of the feeds, the tables and the result documents."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

# --- feeds -----------------------------------------------------------------
# Field names and nesting of the three nested feeds.

HOURLY_FEED = "httpRequests1hGroups"
FIREWALL_FEED = "firewallEventsAdaptive"
DETAILS_FEED = "httpRequestsAdaptiveGroups"

COUNTRY_ENTRY = _struct(
    ("clientCountryName", S), ("requests", L), ("threats", L), ("bytes", L)
)
STATUS_ENTRY = _struct(("edgeResponseStatus", I), ("requests", L))

HOURLY_GROUP = _struct(
    ("dimensions", _struct(("datetime", S))),
    (
        "sum",
        _struct(
            ("requests", L),
            ("bytes", L),
            ("threats", L),
            ("countryMap", T.ArrayType(COUNTRY_ENTRY)),
            ("responseStatusMap", T.ArrayType(STATUS_ENTRY)),
        ),
    ),
    ("uniq", _struct(("uniques", L))),
)

FIREWALL_EVENT = _struct(
    ("action", S),
    ("clientIP", S),
    ("clientCountryName", S),
    ("clientRequestHTTPHost", S),
    ("clientRequestHTTPMethodName", S),
    ("clientRequestPath", S),
    ("datetime", S),
    ("userAgent", S),
    ("ruleId", S),
    ("source", S),
    ("rayName", S),
)

DETAILS_GROUP = _struct(
    ("count", L),
    (
        "dimensions",
        _struct(
            ("clientCountryName", S),
            ("clientRequestHTTPMethodName", S),
            ("edgeResponseStatus", I),
            ("clientRequestPath", S),
        ),
    ),
)


def payload_schema(feed: str) -> T.StructType:
    """Schema of one response document carrying ``feed``."""
    entry = {
        HOURLY_FEED: HOURLY_GROUP,
        FIREWALL_FEED: FIREWALL_EVENT,
        DETAILS_FEED: DETAILS_GROUP,
    }[feed]
    zone = _struct((feed, T.ArrayType(entry)))
    return _struct(("data", _struct(("viewer", _struct(("zones", T.ArrayType(zone)))))))


# --- tables ----------------------------------------------------------------

# Where a row stands in the order of writing: the run's number first, then the landed
# file by arrival. Within a file ``ingest_seq`` counts on.
ARRIVAL = _struct(
    ("run_seq", L), ("landed_at", T.TimestampType()), ("landed_file", S), ("landed_block", L)
)

HOURLY_TRAFFIC = _struct(
    ("collected_at", S),
    ("bucket", S),
    ("country", S),
    ("http_method", S),
    ("status_code", I),
    ("content_type", S),
    ("request_count", L),
    ("bytes_total", L),
    ("threats", L),
    ("unique_visitors", L),
    ("ingest_seq", L),
    ("arrival", ARRIVAL),
)

FIREWALL_EVENTS = _struct(
    ("collected_at", S),
    ("event_datetime", S),
    ("action", S),
    ("client_ip", S),
    ("country", S),
    ("host", S),
    ("http_method", S),
    ("request_path", S),
    ("user_agent", S),
    ("rule_id", S),
    ("source", S),
    ("ray_name", S),
    ("ingest_seq", L),
    ("arrival", ARRIVAL),
)

REQUEST_DETAILS = _struct(
    ("collected_at", S),
    ("bucket", S),
    ("country", S),
    ("http_method", S),
    ("status_code", I),
    ("path", S),
    ("request_count", L),
    ("ingest_seq", L),
    ("arrival", ARRIVAL),
)

ML_RESULTS = _struct(
    ("run_at", S),
    ("model_name", S),
    ("result_type", S),
    ("result_json", S),
    ("ingest_seq", L),
)

HOURLY_KEY = ["bucket", "country", "http_method", "status_code"]
FIREWALL_KEY = ["ray_name"]
DETAILS_KEY = ["bucket", "country", "http_method", "status_code", "path"]

# --- result documents ------------------------------------------------------

COUNT_MAP = T.MapType(S, L)

PERSONA_DOC = _struct(
    ("n_clusters", I),
    ("total_rows_analyzed", L),
    ("inertia", D),
    (
        "profiles",
        T.ArrayType(
            _struct(
                ("cluster_id", I),
                ("size", L),
                ("avg_requests", D),
                ("avg_bytes", D),
                ("total_threats", L),
                ("top_countries", COUNT_MAP),
                ("threat_ratio", D),
                ("label", S),
            )
        ),
    ),
)

ANOMALY_DOC = _struct(
    ("total_buckets_analyzed", L),
    ("anomalies_found", L),
    ("contamination_rate", D),
    ("baseline_mean_requests", D),
    ("baseline_std_requests", D),
    (
        "anomalies",
        T.ArrayType(
            _struct(
                ("bucket", S),
                ("total_requests", L),
                ("total_bytes", L),
                ("total_threats", L),
                ("unique_countries", L),
                ("anomaly_score", D),
            )
        ),
    ),
)

GEO_DOC = _struct(
    ("total_countries", L),
    ("total_requests", L),
    (
        "countries",
        T.ArrayType(
            _struct(
                ("country", S),
                ("requests", L),
                ("bytes", L),
                ("threats", L),
                ("pct", D),
                ("threat_ratio", D),
            )
        ),
    ),
)

FIREWALL_DOC = _struct(
    ("total_events", L),
    ("by_action", COUNT_MAP),
    ("by_source", COUNT_MAP),
    ("top_countries", T.ArrayType(_struct(("country", S), ("count", L)))),
    ("top_paths", COUNT_MAP),
    ("top_user_agents", T.ArrayType(_struct(("ua", S), ("count", L)))),
)

SUMMARY_DOC = _struct(
    ("data_rows", L),
    ("earliest_data", S),
    ("latest_data", S),
    ("total_requests", L),
    ("total_bytes", L),
    ("total_threats", L),
    ("unique_countries", L),
    ("firewall_events", L),
)

# Model name -> (result type, document schema).
RESULTS = {
    "kmeans_traffic": ("cluster_profiles", PERSONA_DOC),
    "isolation_forest": ("anomaly_detection", ANOMALY_DOC),
    "geo_analysis": ("country_distribution", GEO_DOC),
    "firewall_analysis": ("event_breakdown", FIREWALL_DOC),
    "summary": ("stats", SUMMARY_DOC),
}

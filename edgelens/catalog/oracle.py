"""Check SQL: an independent statement of each query over the raw test tables."""

from __future__ import annotations

ISO = "'%Y-%m-%dT%H:%M:%SZ'"

EVENTS = """
ev AS (SELECT event_id, ts, user_id, event_type, value,
              CAST(json_extract(props, '$.k') AS BIGINT) AS k,
              strftime(ts, '%Y-%m-%dT%H:00:00Z') AS bucket,
              strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS second
       FROM events),
places AS (SELECT c_custkey, c_mktsegment, n_name
           FROM customer JOIN nation ON c_nationkey = n_nationkey),
lim AS (SELECT strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS now,
               strftime(max(ts) - INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%SZ') AS week_ago,
               strftime(max(ts) - INTERVAL 24 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS day_ago
        FROM events)"""


def hourly(name: str, where: str = "true", collected_at: str = "(SELECT now FROM lim)") -> str:
    return f"""
{name} AS (SELECT {collected_at} AS collected_at, bucket,
       CASE WHEN n_name <> 'NATION_0' THEN n_name END AS country,
       '' AS http_method, 0 AS status_code, '' AS content_type,
       CAST(sum(floor(value)) AS BIGINT) AS request_count,
       CAST(sum(k * 1000) AS BIGINT) AS bytes_total,
       CAST(sum(CASE WHEN event_type = 'error' THEN floor(value / 4) ELSE 0 END) AS BIGINT) AS threats,
       count(DISTINCT user_id) AS unique_visitors,
       CAST((date_diff('day', DATE '2000-01-01', CAST(substr(bucket, 1, 10) AS DATE)) * 24
             + CAST(substr(bucket, 12, 2) AS INT)) * 100
            + CAST(replace(n_name, 'NATION_', '') AS INT) AS BIGINT) AS ingest_seq
  FROM ev JOIN places ON user_id = c_custkey
  WHERE {where}
  GROUP BY bucket, n_name)"""


HT = EVENTS + "," + hourly("ht")
RECENT = HT + ", recent AS (SELECT * FROM ht WHERE bucket >= (SELECT week_ago FROM lim))"
HOURS = (
    RECENT
    + """, hours AS (
  SELECT bucket, CAST(sum(request_count) AS BIGINT) AS total_requests,
         CAST(sum(bytes_total) AS BIGINT) AS total_bytes,
         CAST(sum(threats) AS BIGINT) AS total_threats,
         count(DISTINCT country) AS unique_countries
  FROM recent GROUP BY bucket)"""
)

FE = (
    EVENTS
    + """,
fe AS (SELECT (SELECT now FROM lim) AS collected_at, second AS event_datetime, event_type AS action,
       '10.0.' || (user_id // 256) || '.' || (user_id % 256) AS client_ip, n_name AS country,
       'host-' || (user_id % 3) AS host,
       CASE user_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'HEAD' ELSE 'PUT' END AS http_method,
       '/k/' || k AS request_path, 'ua-' || (user_id % 40) AS user_agent, 'r' || (k % 10) AS rule_id,
       c_mktsegment AS source,
       CASE WHEN event_id % 100 = 0 THEN '' ELSE 'ray-' || event_id END AS ray_name, event_id
  FROM ev JOIN places ON user_id = c_custkey),
recent_fe AS (SELECT * FROM fe WHERE event_datetime >= (SELECT week_ago FROM lim))"""
)

RD = (
    EVENTS
    + """,
rd AS (SELECT CASE WHEN second < '2024-01-16T00:00:00Z' THEN '2024-01-01T00:00:00Z'
                   ELSE '2024-01-16T00:00:00Z' END AS bucket,
       n_name AS country,
       CASE user_id % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'HEAD' ELSE 'PUT' END AS http_method,
       CASE event_type WHEN 'error' THEN 500 WHEN 'view' THEN 200 WHEN 'click' THEN 302
            WHEN 'signup' THEN 201 ELSE 202 END AS status_code,
       '/k/' || (k // 20) AS path, count(*) AS request_count
  FROM ev JOIN places ON user_id = c_custkey GROUP BY ALL)"""
)

LARGE = """
ht AS (SELECT strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS bucket, n_name AS country,
              CAST(sum(l_quantity) AS BIGINT) AS request_count,
              CAST(sum(floor(l_extendedprice * 100)) AS BIGINT) AS bytes_total,
              CAST(sum(CASE WHEN l_returnflag = 'R' THEN floor(l_quantity / 8) ELSE 0 END) AS BIGINT) AS threats
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
       GROUP BY l_shipdate, n_name)"""

GEO_TAIL = """,
c AS (SELECT country, CAST(sum(request_count) AS BIGINT) AS requests,
             CAST(sum(bytes_total) AS BIGINT) AS bytes, CAST(sum(threats) AS BIGINT) AS threats
      FROM ht WHERE country IS NOT NULL GROUP BY country),
t AS (SELECT count(*) AS total_countries, CAST(sum(requests) AS BIGINT) AS total_requests,
             greatest(sum(requests), 1) AS d FROM c),
geo AS (SELECT country, requests, bytes, threats,
       CAST((2 * requests::HUGEINT * 10000 + d) // (2 * d) AS DOUBLE) / 100 AS pct,
       CAST((2 * threats::HUGEINT * 1000000 + greatest(requests, 1)) // (2 * greatest(requests, 1)) AS DOUBLE)
         / 10000 AS threat_pct,
       total_countries, total_requests
  FROM c, t ORDER BY requests DESC, country LIMIT 50)"""
GEO = HT + GEO_TAIL

DIRTY = (
    HT
    + """,
dirty AS (SELECT * FROM ht UNION ALL
  SELECT collected_at, bucket, country, NULL, NULL, content_type, request_count, bytes_total, threats,
         unique_visitors, ingest_seq + 100000000
  FROM ht WHERE bucket LIKE '%T03:00:00Z')"""
)

PERSONA_TAIL = """,
cl AS (SELECT *, CAST(CASE WHEN threats * 5 > request_count THEN 5
                           ELSE least(4, request_count // 45) END AS INT) AS cluster
       FROM ht WHERE country IS NOT NULL),
pr AS (SELECT cluster, count(*) AS size,
              CAST(sum(request_count) AS DOUBLE) / count(*) AS avg_requests,
              CAST(sum(bytes_total) AS DOUBLE) / count(*) AS avg_bytes,
              CAST(sum(threats) AS BIGINT) AS total_threats,
              CAST(sum(threats) AS DOUBLE) / greatest(sum(request_count), 1) AS threat_ratio
       FROM cl GROUP BY cluster),
ranked AS (SELECT CAST(row_number() OVER (ORDER BY avg_requests DESC, cluster) - 1 AS INT) AS rank, * FROM pr),
tops AS (SELECT cluster, CAST(place AS INT) AS place, country, n AS count FROM (
           SELECT cluster, country, n, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, country) AS place
           FROM (SELECT cluster, country, count(*) AS n FROM cl GROUP BY cluster, country))
         WHERE place <= 3)"""
PERSONAS = HT + PERSONA_TAIL

LABELS = (
    PERSONAS
    + """,
q AS (SELECT quantile_cont(request_count, 0.25) AS q25, quantile_cont(request_count, 0.5) AS q50,
             quantile_cont(request_count, 0.9) AS q90 FROM cl),
facts AS (SELECT ranked.*, q.*, (SELECT country FROM tops WHERE tops.cluster = ranked.cluster AND place = 1) AS main
          FROM ranked, q),
fold AS (
  SELECT -1 AS rank, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS VARCHAR) AS label
  UNION ALL
  SELECT rank, list_append(used, base), CASE WHEN list_contains(used, base) THEN base || ' (' || main || ')' ELSE base END
  FROM (SELECT f.rank, fold.used, f.main,
          CASE WHEN f.threat_ratio > 0.1 AND NOT list_contains(used, 'Suspicious Traffic') THEN 'Suspicious Traffic'
               WHEN f.threat_ratio > 0.05 AND NOT list_contains(used, 'Elevated Threat') THEN 'Elevated Threat'
               WHEN f.avg_requests > f.q90 AND NOT list_contains(used, 'High-Volume Visitors')
                 THEN 'High-Volume Visitors'
               WHEN f.avg_requests > f.q50 AND NOT list_contains(used, 'Moderate Traffic') THEN 'Moderate Traffic'
               WHEN f.avg_requests <= f.q25 AND NOT list_contains(used, 'Low-Volume / Crawlers')
                 THEN 'Low-Volume / Crawlers'
               ELSE 'Mixed Traffic' END AS base
        FROM fold JOIN facts f ON f.rank = fold.rank + 1)),
labelled AS (SELECT ranked.*, fold.label FROM ranked JOIN fold USING (rank))"""
)

LOG = (
    HT
    + """,
runs AS (SELECT seq, strftime(m - CAST(h AS INT) * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS run_at
         FROM (SELECT max(ts) AS m FROM events), (VALUES (0, 12), (1, 6), (2, 0)) AS s(seq, h)),
tr AS (SELECT seq, run_at, count(*) AS data_rows, count(DISTINCT country) AS total_countries,
              count(country) AS total_rows_analyzed, count(DISTINCT bucket) AS total_buckets_analyzed
       FROM runs JOIN ht ON bucket <= run_at GROUP BY seq, run_at),
act AS (SELECT seq, event_type, count(*) AS n FROM runs JOIN ev ON second <= run_at GROUP BY seq, event_type),
fw AS (SELECT seq, CAST(sum(n) AS BIGINT) AS total_events, count(*) AS n_actions,
              first(event_type ORDER BY n DESC, event_type) AS first_action FROM act GROUP BY seq),
log AS (SELECT CAST(seq AS BIGINT) AS ingest_seq, run_at, model_name, result_type,
          CASE model_name WHEN 'summary' THEN data_rows WHEN 'geo_analysis' THEN total_countries
               WHEN 'firewall_analysis' THEN total_events WHEN 'kmeans_traffic' THEN total_rows_analyzed
               ELSE total_buckets_analyzed END AS headline, n_actions, first_action
        FROM tr JOIN fw USING (seq),
             (VALUES ('summary', 'stats'), ('geo_analysis', 'country_distribution'),
                     ('firewall_analysis', 'event_breakdown'), ('kmeans_traffic', 'cluster_profiles'),
                     ('isolation_forest', 'anomaly_detection')) AS m(model_name, result_type))"""
)

FALLBACK = """
flat AS (SELECT bucket, country, '' AS http_method, 0 AS status_code, '' AS content_type, request_count,
                bytes_total, threats, CAST(0 AS BIGINT) AS unique_visitors
         FROM ht WHERE bucket NOT LIKE '%T05:00:00Z'
         UNION ALL
         SELECT bucket, 'Unknown', '', 0, '', CAST(sum(floor(value)) AS BIGINT), CAST(sum(k * 1000) AS BIGINT),
                CAST(sum(CASE WHEN event_type = 'error' THEN floor(value / 4) ELSE 0 END) AS BIGINT),
                count(DISTINCT user_id)
         FROM ev WHERE bucket LIKE '%T05:00:00Z' GROUP BY bucket)"""

BATCHES = (
    EVENTS
    + ","
    + hourly("a", "event_id % 2 = 0", "'2024-01-16T00:00:00Z'")
    + ","
    + hourly("b", "ts >= TIMESTAMP '2024-01-14'", "'2024-01-31T00:00:00Z'")
)

FE_BATCHES = (
    FE
    + """,
loads AS (SELECT '2024-01-16T00:00:00Z' AS loaded, * REPLACE ('2024-01-16T00:00:00Z' AS collected_at)
          FROM fe WHERE event_datetime < '2024-01-16T00:00:00Z'
          UNION ALL
          SELECT '2024-01-31T00:00:00Z', * REPLACE ('2024-01-31T00:00:00Z' AS collected_at, 'late' AS action)
          FROM fe WHERE event_datetime >= '2024-01-14T00:00:00Z'),
firsts AS (SELECT * FROM loads QUALIFY row_number() OVER (PARTITION BY ray_name ORDER BY loaded, event_id) = 1)"""
)

HOURLY_SUMS = """SELECT bucket, CASE WHEN n_name <> 'NATION_0' THEN n_name END AS country,
  CAST(sum(floor(value)) AS BIGINT) AS request_count, CAST(sum(k * 1000) AS BIGINT) AS bytes_total,
  CAST(sum(CASE WHEN event_type = 'error' THEN floor(value / 4) ELSE 0 END) AS BIGINT) AS threats
FROM ev JOIN places ON user_id = c_custkey GROUP BY bucket, n_name"""


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes.strip()}\n{select.strip()}"


def _counts(column: str, alias: str, limit: int | None = None) -> str:
    tail = "" if limit is None else f" LIMIT {limit}"
    return _with(
        FE,
        f"SELECT {column} AS {alias}, count(*) AS count FROM recent_fe WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column}{tail}",
    )


ROLLUP = """SELECT bucket, CAST(sum(request_count) AS BIGINT) AS total_requests,
  CAST(sum(bytes_total) AS BIGINT) AS total_bytes, CAST(sum(threats) AS BIGINT) AS total_threats,
  count(DISTINCT country) AS unique_countries FROM ht GROUP BY bucket"""
QUANTILES = """SELECT quantile_cont(request_count, 0.25) AS q25, quantile_cont(request_count, 0.5) AS q50,
  quantile_cont(request_count, 0.9) AS q90 FROM ht WHERE country IS NOT NULL"""
SUMMARY = """SELECT count(*) AS data_rows, min(bucket) AS earliest_data, max(bucket) AS latest_data,
  CAST(coalesce(sum(request_count), 0) AS BIGINT) AS total_requests,
  CAST(coalesce(sum(bytes_total), 0) AS BIGINT) AS total_bytes,
  CAST(coalesce(sum(threats), 0) AS BIGINT) AS total_threats,
  count(DISTINCT country) AS unique_countries, (SELECT count(*) FROM events) AS firewall_events FROM ht"""

Z = ", ".join(
    f"round(CASE WHEN s.s_{c} > 0 THEN (r.{c} - s.m_{c}) / s.s_{c} ELSE 0.0 END, 6) + 0.0 AS {c}_z"
    for c in ("country_code", "request_count", "bytes_total", "threats")
)
STATS = ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}"
    for c in ("country_code", "request_count", "bytes_total", "threats")
)
DISPLAY = "strftime({0}, '%b %-d, %-I:%M %p UTC')"

ORACLE: dict[str, str] = {
    "src_hourly_flatten": _with(HT + "," + FALLBACK, "SELECT * FROM flat"),
    "src_hourly_fallback": _with(HT + "," + FALLBACK, "SELECT * FROM flat WHERE country = 'Unknown'"),
    "src_firewall_flatten": _with(
        FE,
        """SELECT * EXCLUDE (event_id) REPLACE (CASE WHEN event_id % 50 = 0 THEN '' ELSE user_agent END AS user_agent)
        FROM fe""",
    ),
    "src_details_flatten": _with(
        RD,
        """SELECT (SELECT now FROM lim) AS collected_at,
           * REPLACE (CASE WHEN path <> '/k/4' THEN status_code END AS status_code) FROM rd""",
    ),
    "src_empty_payload": _with(
        HT + "," + FALLBACK,
        """SELECT hour, payloads, CASE WHEN hour IN ('06', '07', '08', '09') THEN 0 ELSE n END AS flattened
        FROM (SELECT substr(bucket, 12, 2) AS hour, count(DISTINCT bucket) AS payloads, count(*) AS n
              FROM flat GROUP BY 1)""",
    ),
    "result_log_append": _with(LOG, "SELECT run_at, model_name, result_type, ingest_seq FROM log"),
    "latest_result_per_model": _with(
        LOG,
        "SELECT model_name, run_at, result_type, headline FROM log WHERE ingest_seq = 2",
    ),
    "scalar_json_roundtrip": _with(
        LOG,
        """SELECT run_at, model_name, headline,
          CASE WHEN model_name = 'firewall_analysis' THEN first_action ELSE '' END AS first_action,
          CASE WHEN model_name = 'firewall_analysis' THEN n_actions ELSE 0 END AS n_actions,
          CAST(0 AS DOUBLE) AS inertia, true AS same_text FROM log""",
    ),
    "view_missing_defaults": _with(
        LOG,
        """SELECT 'partial' AS log, model_name, model_name IN ('summary', 'firewall_analysis') AS has_result,
          CASE WHEN model_name IN ('summary', 'firewall_analysis') THEN run_at ELSE '' END AS run_at,
          CASE WHEN model_name IN ('summary', 'firewall_analysis') THEN headline ELSE 0 END AS headline,
          CAST(0 AS BIGINT) AS listed
        FROM log WHERE ingest_seq = 2
        UNION ALL SELECT 'absent', model_name, false, '', 0, 0 FROM log WHERE ingest_seq = 2
        UNION ALL SELECT 'absent', 'cards', false, '', 0, 0""",
    ),
    "filter_open_interval": _with(
        FE,
        """SELECT event_datetime, ray_name, action, client_ip FROM fe
        WHERE event_datetime > (SELECT day_ago FROM lim) AND event_datetime < (SELECT now FROM lim)""",
    ),
    "filter_rolling_7d": _with(
        RECENT,
        "SELECT bucket, country, request_count, bytes_total, threats, unique_visitors FROM recent",
    ),
    "cap_top_n": _with(
        FE + RD[len(EVENTS):],
        """SELECT * FROM (SELECT 'firewall' AS feed, event_datetime AS sorted_by, CAST(event_id AS VARCHAR) AS item
          FROM fe ORDER BY event_datetime, event_id LIMIT 1000)
        UNION ALL
        SELECT * FROM (SELECT 'details', CAST(request_count AS VARCHAR),
          bucket || '|' || country || '|' || http_method || '|' || status_code || '|' || path
          FROM rd ORDER BY request_count DESC, bucket, country, http_method, status_code, path LIMIT 1000)""",
    ),
    "gate_min_rows": _with(
        HOURS,
        """SELECT CAST(g AS BIGINT) AS min_rows, CASE WHEN n >= g THEN n ELSE 0 END AS rows_out
        FROM (SELECT count(*) AS n FROM hours), (VALUES (5), (169), (100000)) AS v(g)""",
    ),
    "empty_window_results": _with(
        FE + "," + hourly("ht"),
        """, late AS (SELECT * FROM ht WHERE bucket >= '2029-12-25T00:00:00Z'),
        late_fe AS (SELECT * FROM fe WHERE event_datetime >= '2029-12-25T00:00:00Z')
        SELECT 'summary' AS result, CAST(1 AS BIGINT) AS result_rows, (SELECT count(*) FROM late) AS total
        UNION ALL SELECT 'firewall_analysis', 1, (SELECT count(*) FROM late_fe)
        UNION ALL SELECT 'geo_analysis', count(DISTINCT country), CAST(coalesce(sum(request_count), 0) AS BIGINT) FROM late
        UNION ALL SELECT 'hours', count(DISTINCT bucket), CAST(coalesce(sum(request_count), 0) AS BIGINT) FROM late""",
    ),
    "rollup_by_bucket": _with(HT, ROLLUP),
    "large_rollup_by_bucket": _with(LARGE, ROLLUP),
    "large_geo_country_distribution": _with(LARGE + GEO_TAIL, "SELECT * FROM geo"),
    "large_request_quantiles": _with(LARGE, QUANTILES),
    "large_persona_profiles": _with(LARGE + PERSONA_TAIL, "SELECT * FROM ranked"),
    "geo_country_distribution": _with(GEO, "SELECT * FROM geo"),
    "series_country_top10": _with(
        GEO, "SELECT country, requests, pct FROM geo ORDER BY requests DESC, country LIMIT 10"
    ),
    "series_threat_top8": _with(
        GEO,
        """SELECT country, requests, threat_pct FROM geo WHERE threat_pct > 0
        ORDER BY requests DESC, country LIMIT 8""",
    ),
    "series_traffic": _with(HOURS, "SELECT bucket, total_requests FROM hours"),
    "series_mark_join": _with(
        HOURS,
        """, top AS (SELECT bucket FROM hours ORDER BY total_requests DESC, bucket LIMIT 2)
        SELECT bucket, strftime(strptime(bucket, '%Y-%m-%dT%H:%M:%SZ'), '%b %-d, %-I%p') AS axis_label, total_requests,
          bucket IN (SELECT bucket FROM top) AS is_anomaly,
          CASE WHEN bucket IN (SELECT bucket FROM top) THEN 'red' ELSE 'blue' END AS colour FROM hours""",
    ),
    "summary_stats": _with(HT, SUMMARY),
    "view_header_cards": _with(
        HT,
        f""", s AS ({SUMMARY})
        SELECT format('{{:,}}', total_requests) AS total_requests, unique_countries,
          format('{{:,}}', total_threats) AS threats_detected, format('{{:,}}', firewall_events) AS firewall_events,
          format('{{:,}}', data_rows) AS data_points,
          {DISPLAY.format("strptime(latest_data, " + ISO + ")")} AS data_through,
          {DISPLAY.format("strptime(earliest_data, " + ISO + ")")} AS data_from FROM s""",
    ),
    "request_quantiles": _with(HT, QUANTILES),
    "anomaly_features": _with(HOURS, "SELECT * FROM hours"),
    "anomaly_baseline": _with(
        HOURS,
        """SELECT count(*) AS total_buckets_analyzed,
          least(0.1::DOUBLE, 2.0::DOUBLE / greatest(count(*), 1)) AS contamination_rate,
          CAST(sum(total_requests) AS DOUBLE) / count(*) AS baseline_mean_requests,
          round(coalesce(stddev_samp(total_requests), 0.0), 6) AS baseline_std_requests FROM hours""",
    ),
    "anomaly_invariants": _with(
        HOURS,
        """SELECT count(*) AS total_buckets_analyzed,
          CAST(CASE WHEN count(*) < 12 THEN 1 ELSE 2 END AS BIGINT) AS anomalies_found,
          least(0.1::DOUBLE, 2.0::DOUBLE / count(*)) AS contamination_rate,
          true AS scores_in_range, true AS flags_match_scores FROM hours""",
    ),
    "rolling_window_7d_by_6h": _with(
        HT,
        """, h AS (SELECT strptime(bucket, '%Y-%m-%dT%H:%M:%SZ') AS t, * FROM ht),
        w AS (SELECT unnest(generate_series(
                (SELECT time_bucket(INTERVAL 6 HOUR, min(t), TIMESTAMP '1970-01-01') - INTERVAL 162 HOUR FROM h),
                (SELECT max(t) FROM h), INTERVAL 6 HOUR)) AS s)
        SELECT strftime(s, '%Y-%m-%dT%H:%M:%SZ') AS window_start,
          strftime(s + INTERVAL 7 DAY, '%Y-%m-%dT%H:%M:%SZ') AS window_end,
          CAST(sum(request_count) AS BIGINT) AS total_requests, CAST(sum(threats) AS BIGINT) AS total_threats
        FROM w JOIN h ON t >= s AND t < s + INTERVAL 7 DAY GROUP BY s""",
    ),
    "fw_by_action": _counts("action", "action"),
    "fw_by_source": _counts("source", "source"),
    "fw_top_countries": _counts("country", "country", 10),
    "fw_top_paths": _counts("request_path", "request_path", 15),
    "fw_top_user_agents": _counts("user_agent", "ua", 10),
    "upsert_hourly_last_wins": _with(
        BATCHES,
        """SELECT collected_at, bucket, country, http_method, status_code, request_count, bytes_total, threats,
          unique_visitors FROM b
        UNION ALL
        SELECT collected_at, bucket, country, http_method, status_code, request_count, bytes_total, threats,
          unique_visitors FROM a
        WHERE country IS NULL OR NOT EXISTS (SELECT 1 FROM b WHERE b.bucket = a.bucket AND b.country = a.country)""",
    ),
    "insert_firewall_first_wins": _with(
        FE_BATCHES, "SELECT collected_at, event_datetime, action, country, source, ray_name FROM firsts"
    ),
    "dedupe_hourly_keep_first": _with(
        DIRTY,
        """SELECT bucket, country, http_method, status_code, content_type, request_count, ingest_seq FROM dirty
        QUALIFY row_number() OVER (PARTITION BY bucket, coalesce(country, ''), coalesce(http_method, ''),
                                   coalesce(status_code, 0) ORDER BY collected_at, ingest_seq) = 1""",
    ),
    "upsert_across_runs": _with(
        HT,
        """SELECT CASE WHEN substr(bucket, 12, 2) < '06' THEN '2024-02-01T00:00:00Z' ELSE '2024-02-02T00:00:00Z' END
          AS collected_at, bucket, country,
          request_count + CASE WHEN substr(bucket, 12, 2) < '06' THEN 2 ELSE 1 END AS request_count
        FROM ht WHERE country IS NOT NULL""",
    ),
    "repair_across_runs": _with(
        HT,
        """SELECT bucket, CASE WHEN country = 'NATION_1' THEN 'Unknown' ELSE coalesce(country, 'Unknown') END AS country,
          '' AS http_method, CAST(sum(request_count) AS BIGINT) AS request_count
        FROM ht GROUP BY ALL""",
    ),
    "src_landing_order": _with(
        HT + "," + FALLBACK,
        """SELECT bucket, country, request_count, bytes_total FROM flat
        UNION ALL
        SELECT bucket, country, CAST('1' || request_count AS BIGINT), bytes_total FROM flat WHERE country IS NULL""",
    ),
    "src_rejected": _with(
        HT,
        """SELECT hour, CASE hour WHEN '08' THEN 'not json' WHEN '10' THEN 'not json' WHEN '11' THEN 'wrong type'
            ELSE 'loaded' END AS reason,
          CASE hour WHEN '10' THEN 3 ELSE 1 END * count(DISTINCT bucket) AS responses
        FROM (SELECT substr(bucket, 12, 2) AS hour, bucket FROM ht)
        WHERE hour NOT IN ('06', '07', '09') GROUP BY hour""",
    ),
    "duplicate_keys": _with(
        DIRTY,
        """SELECT bucket, coalesce(country, '') AS country, coalesce(http_method, '') AS http_method,
          coalesce(status_code, 0) AS status_code, count(*) AS copies FROM dirty
        GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""",
    ),
    "normalize_null_dims": _with(
        DIRTY,
        """SELECT bucket, coalesce(country, 'Unknown') AS country, coalesce(http_method, '') AS http_method,
          coalesce(status_code, 0) AS status_code, coalesce(content_type, '') AS content_type, request_count,
          ingest_seq FROM dirty""",
    ),
    "append_details": _with(
        RD,
        """SELECT '2024-01-16T00:00:00Z' AS collected_at, * FROM rd
        UNION ALL
        SELECT '2024-01-17T00:00:00Z', * FROM rd WHERE bucket = '2024-01-16T00:00:00Z'""",
    ),
    "feature_country_code": _with(
        HT,
        """SELECT country, CAST(dense_rank() OVER (ORDER BY country) - 1 AS INT) AS country_code, n AS coded_rows
        FROM (SELECT country, count(*) AS n FROM ht WHERE country IS NOT NULL GROUP BY country)""",
    ),
    "feature_zscores": _with(
        HT,
        f""", r AS (SELECT *, dense_rank() OVER (ORDER BY country) - 1 AS country_code FROM ht WHERE country IS NOT NULL),
        s AS (SELECT {STATS} FROM r)
        SELECT r.bucket, r.country, {Z} FROM r, s""",
    ),
    "choose_k": _with(
        HT,
        """SELECT count(*) AS total_rows, CAST(least(greatest(2, count(*) // 20), 6) AS INT) AS n_clusters
        FROM ht WHERE country IS NOT NULL""",
    ),
    "persona_profiles": _with(PERSONAS, "SELECT * FROM ranked"),
    "persona_top_countries": _with(PERSONAS, "SELECT * FROM tops"),
    "persona_labels": _with(
        LABELS, "SELECT rank, cluster, avg_requests, threat_ratio, label FROM labelled", recursive=True
    ),
    "view_persona_cards": _with(
        LABELS,
        """SELECT rank, label,
          CASE WHEN threat_ratio > 0.1 THEN 'red' WHEN avg_requests > 100 THEN 'green' ELSE 'blue' END AS icon,
          size, printf('%.1f', avg_requests) AS avg_requests, total_threats,
          (SELECT string_agg(country, ', ' ORDER BY place) FROM tops WHERE tops.cluster = labelled.cluster) AS countries
        FROM labelled""",
        recursive=True,
    ),
    "series_persona_bubbles": _with(
        LABELS,
        """SELECT rank, label, avg_requests AS x, total_threats AS y, greatest(sqrt(size) * 3, 6.0::DOUBLE) AS radius,
          CAST(rank % 8 AS INT) AS colour_index FROM labelled""",
        recursive=True,
    ),
    "persona_kmeans_invariants": _with(
        HT,
        """SELECT CAST(least(greatest(2, count(*) // 20), 6) AS INT) AS n_clusters, count(*) AS total_rows,
          count(*) AS sum_size, CAST(sum(threats) AS BIGINT) AS sum_threats,
          CAST(sum(request_count) AS BIGINT) AS sum_requests,
          CAST(least(greatest(2, count(*) // 20), 6) AS INT) AS clusters_used,
          true AS nearest, true AS central, true AS cheapest FROM ht WHERE country IS NOT NULL""",
    ),
    "scalar_time_format": _with(
        EVENTS,
        f"""SELECT DISTINCT bucket, bucket AS hour,
          strftime(date_trunc('day', ts) - INTERVAL 171 HOUR, {ISO}) AS week_before,
          {DISPLAY.format("date_trunc('hour', ts)")} AS shown, 'bad ' || bucket AS shown_bad,
          strftime(date_trunc('hour', ts), '%b %-d, %-I%p') AS axis, strftime(ts, '%Y-%m-%d') AS date FROM ev""",
    ),
    "scalar_numeric_guard": _with(
        HT,
        """, g AS (SELECT *, greatest(request_count, 1) AS d FROM ht)
        SELECT bucket, coalesce(country, 'Unknown') AS country,
          CAST((2 * threats::HUGEINT * 10000 + d) // (2 * d) AS DOUBLE) / 100 AS share_pct,
          CAST((2 * threats::HUGEINT * 1000000 + d) // (2 * d) AS DOUBLE) / 10000 AS threat_pct,
          CAST(request_count AS DOUBLE) / greatest(threats, 1) AS ratio,
          CAST(least(greatest(2, request_count // 20), 6) AS INT) AS clusters,
          least(0.1::DOUBLE, 2.0::DOUBLE / d) AS contamination,
          round(CAST(bytes_total AS DOUBLE) / 1024 / 1024, 6) AS megabytes,
          round(greatest(sqrt(unique_visitors) * 3, 6.0::DOUBLE), 6) AS radius,
          CAST(request_count % 8 AS INT) AS colour,
          CASE WHEN CAST(threats AS DOUBLE) / d > 0.1 THEN 'red' WHEN request_count > 100 THEN 'green' ELSE 'blue'
            END AS icon,
          format('{:,}', bytes_total) AS bytes_shown FROM g""",
    ),
    "stream_ingest": _with(
        FE,
        """SELECT event_datetime, action, client_ip, host, http_method, request_path, user_agent, rule_id, ray_name
        FROM fe""",
    ),
    "stream_hourly_rollup": _with(EVENTS, HOURLY_SUMS),
    "stream_upsert": _with(
        EVENTS, f"SELECT * REPLACE (coalesce(country, 'Unknown') AS country) FROM ({HOURLY_SUMS})"
    ),
    "stream_upsert_unknown": _with(
        EVENTS,
        f"""SELECT bucket, CASE WHEN country = 'NATION_1' THEN 'Unknown' ELSE coalesce(country, 'Unknown') END AS country,
          CAST(sum(request_count) AS BIGINT) AS request_count, CAST(sum(bytes_total) AS BIGINT) AS bytes_total,
          CAST(sum(threats) AS BIGINT) AS threats FROM ({HOURLY_SUMS}) GROUP BY ALL""",
    ),
    "stream_dedupe": _with(
        FE_BATCHES, "SELECT collected_at, event_datetime, action, ray_name FROM firsts"
    ),
}

SEPARATED = (
    EVENTS
    + ","
    + hourly("plain")
    + """,
ht AS (SELECT 'G' || (ingest_seq % 6) AS country, (ingest_seq % 6 + 1) * 100000 + request_count % 7 AS request_count,
              (ingest_seq % 6 + 1) * 1000000 AS bytes_total, (ingest_seq % 6) * (ingest_seq % 6) * 3000 AS threats,
              ingest_seq
       FROM plain WHERE country IS NOT NULL)"""
)
BY_GROUP = LABELS[len(HT) :].replace(
    """CAST(CASE WHEN threats * 5 > request_count THEN 5
                           ELSE least(4, request_count // 45) END AS INT)""",
    "CAST(ingest_seq % 6 AS INT)",
)
SPIKED = (
    HOURS
    + """,
spiked AS (SELECT bucket, total_requests * m AS total_requests, total_bytes * m AS total_bytes,
                  total_threats * m AS total_threats, unique_countries, m > 1 AS marked
           FROM (SELECT *, CASE WHEN row_number() OVER (ORDER BY total_requests DESC, bucket) <= 2
                                THEN 1000 ELSE 1 END AS m FROM hours))"""
)
LISTED = FE + "".join(
    f""",
{name} AS (SELECT '{name}' AS list, CAST(row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS INT) AS place,
           {column} AS value, count(*) AS count FROM recent_fe GROUP BY {column} ORDER BY place LIMIT {limit})"""
    for name, column, limit in (
        ("by_action", "action", 1000000),
        ("by_source", "source", 1000000),
        ("top_paths", "request_path", 15),
        ("top_countries", "country", 10),
        ("top_user_agents", "user_agent", 10),
    )
)
PERSONA_DOC = """SELECT {clusters}, CAST((SELECT count(*) FROM cl) AS BIGINT) AS total_rows_analyzed,
  {own} size, avg_requests, avg_bytes, total_threats, threat_ratio, label,
  (SELECT string_agg(country, ', ' ORDER BY place) FROM tops WHERE tops.cluster = labelled.cluster) AS top_countries
  FROM labelled"""

ORACLE |= {
    "persona_kmeans": _with(
        SEPARATED + BY_GROUP, PERSONA_DOC.format(clusters="CAST(6 AS INT) AS n_clusters", own=""), recursive=True
    ),
    "anomaly_isolation_forest": _with(
        SPIKED,
        """SELECT bucket, total_requests, total_bytes, total_threats, unique_countries
        FROM spiked WHERE marked""",
    ),
    "series_traffic_marked": _with(
        SPIKED,
        """SELECT bucket, strftime(strptime(bucket, '%Y-%m-%dT%H:%M:%SZ'), '%b %-d, %-I%p') AS axis_label, total_requests,
          marked AS is_anomaly, CASE WHEN marked THEN 'red' ELSE 'blue' END AS colour FROM spiked""",
    ),
    "doc_summary": _with(HT, SUMMARY),
    "store_unfinished_run": _with(
        FE + "," + hourly("ht"),
        """SELECT 'hourly_traffic' AS "table",
          count(*) + count(*) FILTER (country IS NULL AND bucket >= '2024-01-10T00:00:00Z' AND bucket < '2024-01-16T00:00:00Z') AS n,
          CAST(sum(request_count + CASE WHEN bucket >= '2024-01-10T00:00:00Z' THEN 1 ELSE 0 END
            + CASE WHEN country IS NULL AND bucket >= '2024-01-10T00:00:00Z' AND bucket < '2024-01-16T00:00:00Z'
                   THEN request_count ELSE 0 END) AS BIGINT) AS amount FROM ht
        UNION ALL
        SELECT 'firewall_events', count(*), CAST(sum(event_id) AS BIGINT) FROM (SELECT event_id FROM fe
          QUALIFY row_number() OVER (PARTITION BY ray_name ORDER BY event_datetime >= '2024-01-16T00:00:00Z', event_id) = 1)""",
    ),
    "append_details_newest": _with(
        RD,
        """SELECT CASE WHEN path <> '/k/4' THEN '2024-01-17T00:00:00Z' ELSE '2024-01-16T00:00:00Z' END AS collected_at,
          * REPLACE (request_count + CASE WHEN path <> '/k/4' THEN 7 ELSE 0 END AS request_count) FROM rd""",
    ),
    "anomaly_table": _with(
        SPIKED,
        f"""SELECT bucket, {DISPLAY.format("strptime(bucket, " + ISO + ")")} AS time_bucket,
          format('{{:,}}', total_requests) AS requests, printf('%.1f', total_bytes / 1024 / 1024) || ' MB' AS bandwidth,
          total_threats AS threats, unique_countries AS countries, '-0.1250' AS score FROM spiked WHERE marked""",
    ),
    "stream_dedupe_recent": _with(
        FE,
        """SELECT event_datetime, action, CASE WHEN event_id % 100 <> 50 THEN ray_name END AS ray_name
        FROM fe, (VALUES (0), (1)) AS c(copy)
        WHERE CASE WHEN event_id % 100 = 50 THEN true
                   WHEN ray_name <> '' THEN copy = 0
                   ELSE copy = 0 AND event_id = (SELECT event_id FROM fe WHERE ray_name = ''
                     ORDER BY event_datetime >= '2024-01-16T00:30:00Z', event_id LIMIT 1) END""",
    ),
    "stream_closed_hours": _with(
        EVENTS,
        f"""SELECT * REPLACE (coalesce(country, 'Unknown') AS country) FROM ({HOURLY_SUMS})
        WHERE strptime(bucket, '%Y-%m-%dT%H:%M:%SZ') + INTERVAL 26 HOUR <= (SELECT max(ts) FROM events)""",
    ),
    "stream_retrain": _with(
        FE + "," + hourly("ht") + "," + FALLBACK,
        """, pulls AS (SELECT i AS ingest_seq, run_at FROM (VALUES (0, '2024-01-11T00:00:00Z'), (1, '2024-01-21T00:00:00Z'),
            (2, (SELECT now FROM lim))) AS p(i, run_at)),
        seen AS (SELECT ingest_seq, run_at, bucket, coalesce(country, 'Unknown') AS country FROM pulls
                 JOIN flat ON bucket < run_at OR (ingest_seq = 2)),
        heads AS (
          SELECT ingest_seq, run_at, 'summary' AS model_name, count(*) AS headline FROM seen GROUP BY ALL
          UNION ALL SELECT ingest_seq, run_at, 'geo_analysis', count(DISTINCT country) FROM seen GROUP BY ALL
          UNION ALL SELECT ingest_seq, run_at, 'kmeans_traffic', count(*) FROM seen GROUP BY ALL
          UNION ALL SELECT ingest_seq, run_at, 'isolation_forest', count(DISTINCT bucket) FROM seen
            WHERE strptime(bucket, '%Y-%m-%dT%H:%M:%SZ') >= strptime(run_at, '%Y-%m-%dT%H:%M:%SZ') - INTERVAL 7 DAY GROUP BY ALL
          UNION ALL SELECT ingest_seq, run_at, 'firewall_analysis', count(*) FROM pulls JOIN fe
            ON (event_datetime < run_at OR ingest_seq = 2)
              AND strptime(event_datetime, '%Y-%m-%dT%H:%M:%SZ') >= strptime(run_at, '%Y-%m-%dT%H:%M:%SZ') - INTERVAL 7 DAY
            GROUP BY ALL)
        SELECT run_at, model_name, CAST(ingest_seq AS BIGINT) AS ingest_seq, headline FROM heads""",
    ),
    "anomaly_scores_walked": _with(HOURS, "SELECT bucket, true AS same FROM hours"),
    "anomaly_trees_grown": _with(
        HOURS,
        """SELECT CAST(t AS INT) AS tree, (SELECT least(256, count(*)) FROM hours) AS root_size, true AS sizes,
          true AS splits, true AS leaves, true AS depths FROM range(100) AS r(t)""",
    ),
    "request_quantiles_sketched": _with(
        HT,
        """SELECT CAST(share AS DOUBLE) AS share, count(*) AS n, count(DISTINCT substr(bucket, 1, 10)) AS dates, true AS inside
        FROM ht, (VALUES (0.25), (0.5), (0.9)) AS v(share) WHERE country IS NOT NULL GROUP BY share""",
    ),
    "doc_geo": _with(
        GEO,
        """SELECT total_countries, total_requests,
          CAST(row_number() OVER (ORDER BY requests DESC, country) - 1 AS INT) AS place,
          country, requests, bytes, threats, pct, threat_pct AS threat_ratio FROM geo""",
    ),
    "doc_firewall": _with(
        LISTED,
        """SELECT (SELECT count(*) FROM recent_fe) AS total_events, * FROM (
          SELECT * FROM by_action UNION ALL SELECT * FROM by_source UNION ALL SELECT * FROM top_paths
          UNION ALL SELECT * FROM top_countries UNION ALL SELECT * FROM top_user_agents)""",
    ),
    "action_shares": _with(LISTED, "SELECT place AS position, value AS action, count FROM by_action"),
    "doc_persona": _with(
        LABELS,
        PERSONA_DOC.format(
            clusters="CAST((SELECT count(*) FROM labelled) AS INT) AS n_clusters", own="cluster AS cluster_id,"
        ),
        recursive=True,
    ),
    "doc_anomaly_header": _with(
        HOURS,
        """SELECT count(*) AS total_buckets_analyzed, least(0.1::DOUBLE, 2.0::DOUBLE / count(*)) AS contamination_rate,
          round(avg(total_requests), 6) AS baseline_mean_requests,
          round(stddev_samp(total_requests), 6) AS baseline_std_requests FROM hours""",
    ),
    "view_anomaly_header": _with(
        HOURS,
        """SELECT count(*) AS total_buckets_analyzed, CAST(2 AS INT) AS anomalies_found,
          printf('%.0f', avg(total_requests)) AS baseline_mean, printf('%.0f', stddev_samp(total_requests)) AS baseline_std
        FROM hours""",
    ),
    "view_persona_header": _with(
        PERSONAS,
        """SELECT CAST((SELECT count(*) FROM pr) AS INT) AS n_clusters,
          format('{:,}', count(*)) AS rows_trained_on FROM cl""",
    ),
}

ORACLE["stream_rolling_7d"] = ORACLE["rolling_window_7d_by_6h"]

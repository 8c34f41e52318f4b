"""Named SQL views for the oracles: the same feeds and intermediate tables, written independently
of the Spark operators. `oracle(body)` puts the views a query names in front of it."""

import re

from wardflow import config as C
from wardflow.sources import topology as T


def flow(length):
    return f"""
SELECT hospital_id, dept_id,
 time_bucket(INTERVAL '{length}', event_ts) + INTERVAL '{length}' AS window_end,
 count(*) FILTER (WHERE event_type = 'arrival') AS arrival_count,
 count(*) FILTER (WHERE event_type = 'discharge') AS discharge_count,
 avg(expected_los_minutes) AS avg_expected_los, avg(actual_los_minutes) AS avg_actual_los,
 avg(CASE WHEN acuity <= 2 THEN 1.0 ELSE 0.0 END) FILTER (WHERE event_type = 'arrival') AS severity_index
FROM pe WHERE event_type IN ('arrival', 'discharge') GROUP BY 1, 2, 3
HAVING count(*) FILTER (WHERE event_type = 'arrival') > 0"""


def flow_full(view):
    return f"""SELECT hospital_id, dept_id, window_end, arrival_count, discharge_count,
 CAST(arrival_count AS DOUBLE) AS arrival_rate, avg_expected_los, avg_actual_los, severity_index,
 sin(2 * pi() * hour(window_end) / 24) AS hour_sin, cos(2 * pi() * hour(window_end) / 24) AS hour_cos
FROM {view}"""


FLOW_DOUBLES = "arrival_rate avg_expected_los avg_actual_los severity_index hour_sin hour_cos"


def asof(facts, ts, extra="f.*"):
    """Newest known value of each signal, one as-of join per signal."""
    joins = "\n".join(
        f"ASOF LEFT JOIN (SELECT hospital_id, window_end AS w, {s} FROM ctx_30m WHERE {s} IS NOT NULL) s{i}"
        f" ON f.hospital_id = s{i}.hospital_id AND f.{ts} >= s{i}.w"
        for i, s in enumerate(["weather_score", "flu_index", "traffic_score", "is_severe_weather"]))
    return f"""SELECT {extra}, s0.weather_score, s1.flu_index, s2.traffic_score, s3.is_severe_weather
FROM {facts} f
{joins}"""


_V = ", ".join(f"coalesce({n}, 0.0) AS v{i}" for i, n in enumerate(C.FEATURES))
_V0 = ", ".join(f"coalesce(f.v{i}, 0.0) AS v{i}" for i in range(10))
_Z = ", ".join(f"(v{i} - {m}) / {s} AS z{i}" for i, (m, s) in enumerate(zip(C.FEATURE_MEAN, C.FEATURE_STD)))

VIEWS = {
    "dept_types": T.as_sql(T.DEPT_TYPES, T.DEPT_TYPES_COLUMNS),
    "hospitals": T.as_sql(T.HOSPITALS, T.HOSPITALS_COLUMNS),
    "edge_types": T.as_sql(T.EDGE_TYPES, T.EDGE_TYPES_COLUMNS),
    "patient_events": """
SELECT CAST(e.event_id AS string) AS event_id,
 CASE e.event_type WHEN 'signup' THEN 'arrival' WHEN 'purchase' THEN 'discharge' ELSE 'transfer' END AS event_type,
 concat('H', CAST(e.user_id % 6 + 1 AS string)) AS hospital_id,
 CASE WHEN e.event_type <> 'click' THEN concat('H', CAST(e.user_id % 6 + 1 AS string), '_', s.suffix) END AS dept_id,
 CAST(e.user_id AS string) AS patient_id,
 CASE WHEN e.event_type <> 'purchase' THEN CAST(e.event_id % 5 + 1 AS int) END AS acuity,
 CASE WHEN e.event_type = 'signup' THEN e.ts END AS arrival_ts,
 CASE WHEN e.event_type = 'purchase' THEN e.ts END AS discharge_ts,
 CASE WHEN e.event_type = 'click' THEN e.ts END AS transfer_ts,
 CASE WHEN e.event_type = 'click' THEN concat('H', CAST(e.user_id % 6 + 1 AS string), '_', s.suffix) END AS source_dept_id,
 CASE WHEN e.event_type = 'click' THEN concat('H', CAST(e.user_id % 6 + 1 AS string), '_', t.suffix) END AS target_dept_id,
 CASE WHEN e.event_type = 'signup' THEN e.value + 1 END AS expected_los_minutes,
 CASE WHEN e.event_type = 'purchase' THEN e.value + 1 END AS actual_los_minutes
FROM events e
JOIN dept_types s ON s.node_idx = e.user_id % 7
JOIN dept_types t ON t.node_idx = (e.user_id + e.event_id % 6 + 1) % 7
WHERE e.event_type IN ('signup', 'purchase', 'click')""",
    "pe": "SELECT *, coalesce(arrival_ts, discharge_ts, transfer_ts) AS event_ts FROM patient_events",
    "context_events": """
SELECT CAST(event_id AS string) AS event_id,
 CASE WHEN event_type = 'error' THEN 'weather' WHEN event_id % 10 = 0 THEN 'flu_index' ELSE 'traffic' END AS event_type,
 concat('H', CAST(user_id % 6 + 1 AS string)) AS hospital_id,
 ts AS event_ts,
 CASE WHEN event_type = 'error' THEN value / 10 END AS temperature_c,
 CASE WHEN event_type = 'error' THEN value / 20 END AS precipitation,
 CASE WHEN event_type = 'error' THEN value / 20 > 10 END AS is_severe,
 CASE WHEN event_type = 'error' THEN least(1.0, value / 300 + CASE WHEN value / 20 > 10 THEN 0.3 ELSE 0.0 END) END AS weather_score,
 CASE WHEN event_type = 'view' AND event_id % 10 = 0 THEN value % 10 END AS flu_index,
 CASE WHEN event_type = 'view' AND event_id % 10 <> 0 THEN value % 100 / 100 END AS congestion_score,
 CASE WHEN event_type = 'view' AND event_id % 10 <> 0 THEN 60 - value % 50 END AS avg_speed_kmh
FROM events
WHERE event_type IN ('error', 'view')""",
    "prediction_pairs": """
SELECT event_id, concat('H', CAST(user_id % 6 + 1 AS string)) AS hospital_id, ts,
 CAST(event_id % 97 AS double) / 97 AS predicted, least(1.0, value / 200) AS actual
FROM events""",
    "raw_forecasts": """
SELECT e.event_id, concat('H', CAST(e.user_id % 6 + 1 AS string)) AS hospital_id,
 concat('H', CAST(e.user_id % 6 + 1 AS string), '_', s.suffix) AS dept_id, e.ts,
 CAST(event_id % 97 AS double) / 97 AS h1, CAST(event_id % 89 AS double) / 89 AS h2,
 CAST(event_id % 83 AS double) / 83 AS h4,
 CASE WHEN event_id % 10 <> 0 THEN CAST(event_id % 79 AS double) / 79 END AS h8
FROM events e JOIN dept_types s ON s.node_idx = e.user_id % 7""",
    "model_rows": """
SELECT concat('H', CAST(user_id % 6 + 1 AS string)) AS hospital_id,
 concat('v', CAST(event_id AS string)) AS model_version, ts AS trained_at, props AS metrics_json,
 event_id % 7 = 0 AS is_active FROM events""",
    "departments": """
SELECT h.hospital_id, concat(h.hospital_id, '_', d.suffix) AS dept_id, d.dept_name, d.dept_type,
 d.capacity, d.floor_number, CAST(h.lat AS DOUBLE) + CAST(d.dlat AS DOUBLE) AS lat,
 CAST(h.lon AS DOUBLE) + CAST(d.dlon AS DOUBLE) AS lon, d.node_idx AS ordinal
FROM hospitals h CROSS JOIN dept_types d""",
    "edges": """
SELECT h.hospital_id, concat(h.hospital_id, '_', e.source) AS source_dept,
 concat(h.hospital_id, '_', e.target) AS target_dept, e.edge_type,
 CAST(e.base_weight AS DOUBLE) AS base_weight, e.ordinal
FROM hospitals h CROSS JOIN edge_types e
WHERE h.hospital_id IN (SELECT DISTINCT hospital_id FROM patient_events)""",
    "flow_10m": flow("10 minutes"),
    "flow_1h": flow("1 hour"),
    "flow_10m_full": flow_full("flow_10m"),
    "flow_1h_full": flow_full("flow_1h"),
    "ctx_30m": """
SELECT hospital_id, time_bucket(INTERVAL '30 minutes', event_ts) + INTERVAL '30 minutes' AS window_end,
 avg(weather_score) AS weather_score, avg(flu_index) AS flu_index, avg(congestion_score) AS traffic_score,
 max(CAST(is_severe AS INT)) AS is_severe_weather
FROM context_events GROUP BY 1, 2""",
    "moves": """
SELECT hospital_id, dept_id, event_ts AS ts, CASE WHEN event_type = 'arrival' THEN 1 ELSE -1 END AS delta
FROM pe WHERE event_type <> 'transfer'
UNION ALL SELECT hospital_id, source_dept_id, event_ts, -1 FROM pe WHERE event_type = 'transfer'
UNION ALL SELECT hospital_id, target_dept_id, event_ts, 1 FROM pe WHERE event_type = 'transfer'""",
    "span": "SELECT date_trunc('hour', min(ts)) AS lo, date_trunc('hour', max(ts)) AS hi FROM events",
    "ticks": """SELECT CAST(unnest(generate_series(lo, hi + INTERVAL '30 days', INTERVAL '1 hour')) AS TIMESTAMP) AS tick
FROM span""",
    "census_1h": """
SELECT a.hospital_id, a.dept_id, t.tick, count(*) AS census
FROM patient_events a JOIN ticks t ON t.tick >= a.arrival_ts
 AND t.tick < a.arrival_ts + to_microseconds(CAST(floor(a.expected_los_minutes * 6e7) AS BIGINT))
WHERE a.event_type = 'arrival' GROUP BY 1, 2, 3""",
    "spine_1h": """
SELECT d.hospital_id, d.dept_id, d.ordinal, CAST(unnest(generate_series(s.lo, s.hi, INTERVAL '1 hour')) AS TIMESTAMP) AS ts
FROM departments d CROSS JOIN span s""",
    "occ_1h": """
SELECT s.hospital_id, s.dept_id, s.ordinal, s.ts, coalesce(c.census, 0) AS census, d.capacity,
 least(1.0, coalesce(c.census, 0) / CAST(d.capacity AS DOUBLE)) AS occupancy_ratio
FROM spine_1h s JOIN departments d USING (hospital_id, dept_id)
LEFT JOIN census_1h c ON c.hospital_id = s.hospital_id AND c.dept_id = s.dept_id AND c.tick = s.ts""",
    "waits": """
SELECT * FROM (SELECT *, (epoch_us(lead(event_ts) OVER (PARTITION BY hospital_id, patient_id
 ORDER BY event_ts, event_id)) - epoch_us(event_ts)) / 6e7 AS wait_minutes FROM pe) WHERE event_type = 'arrival'""",
    "wait_1h": """
SELECT hospital_id, dept_id, time_bucket(INTERVAL '1 hour', event_ts) + INTERVAL '1 hour' AS window_end,
 avg(wait_minutes) AS avg_wait_time FROM waits GROUP BY 1, 2, 3""",
    "los_1h": """
SELECT *, (avg_actual_los - los_baseline) / los_baseline AS los_deviation FROM (
 SELECT *, sum(avg_expected_los * arrival_count) OVER w / sum(arrival_count) OVER w AS los_baseline
 FROM flow_1h_full WINDOW w AS (PARTITION BY hospital_id, dept_id ORDER BY window_end
  RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW))""",
    "feat_facts": """
SELECT l.*, o.occ AS occupancy_ratio, w.avg_wait_time FROM los_1h l
LEFT JOIN (SELECT c.hospital_id, c.dept_id, c.tick, least(1.0, c.census / CAST(d.capacity AS DOUBLE)) AS occ
 FROM census_1h c JOIN departments d USING (hospital_id, dept_id)) o
 ON o.hospital_id = l.hospital_id AND o.dept_id = l.dept_id AND o.tick = l.window_end
LEFT JOIN wait_1h w ON w.hospital_id = l.hospital_id AND w.dept_id = l.dept_id AND w.window_end = l.window_end""",
    "feat_1h": asof("feat_facts", "window_end"),
    "vec_1h": f"SELECT hospital_id, dept_id, window_end, {_V} FROM feat_1h",
    "grid_1h": f"""
SELECT s.hospital_id, s.dept_id, s.ordinal, s.ts, {_V0} FROM spine_1h s
LEFT JOIN vec_1h f ON f.hospital_id = s.hospital_id AND f.dept_id = s.dept_id AND f.window_end = s.ts""",
    "zgrid_1h": f"SELECT *, {_Z} FROM grid_1h",
    "transfers": """
SELECT hospital_id, source_dept_id AS source_dept, target_dept_id AS target_dept, count(*) AS transfer_count
FROM patient_events WHERE event_type = 'transfer' GROUP BY 1, 2, 3""",
    "sym_edges": """
SELECT *, false AS reversed FROM edges
UNION ALL SELECT hospital_id, target_dept, source_dept, edge_type, base_weight, ordinal, true FROM edges
WHERE edge_type IN ('SHARED_RESOURCE', 'PROXIMITY')""",
    "base_edges": """
SELECT hospital_id, source_dept, target_dept, arg_max(base_weight * CASE edge_type WHEN 'TRANSFER' THEN 1.0::DOUBLE
 WHEN 'SHARED_RESOURCE' THEN 0.8::DOUBLE WHEN 'PROXIMITY' THEN 0.4::DOUBLE ELSE 0.5::DOUBLE END, ordinal) AS base
FROM sym_edges GROUP BY 1, 2, 3""",
    "wedges": """
SELECT hospital_id, source_dept, target_dept, edge_type, ordinal, reversed, raw,
 raw / greatest(sum(raw) OVER (PARTITION BY hospital_id, source_dept), 1e-8) AS weight FROM (
 SELECT s.*, 0.6::DOUBLE * coalesce(b.base, 0.3) + 0.4::DOUBLE * coalesce(c.transfer_count, 0) / greatest(
   (SELECT max(transfer_count) FROM transfers m WHERE m.hospital_id = s.hospital_id), 1) AS raw
 FROM sym_edges s LEFT JOIN base_edges b USING (hospital_id, source_dept, target_dept)
 LEFT JOIN transfers c USING (hospital_id, source_dept, target_dept))""",
    "preds": """
SELECT event_id, hospital_id, dept_id, hour_ts AS ts, h1, h2, h4, h8,
 floor(greatest(h1, h2, h4, h8) * 1e4 + 0.5) / 1e4 AS max_congestion,
 CASE WHEN greatest(h1, h2, h4, h8) < 0.6 THEN 'green'
  WHEN greatest(h1, h2, h4, h8) < 0.8 THEN 'amber' ELSE 'red' END AS severity_label
FROM (SELECT *, date_trunc('hour', ts) AS hour_ts, row_number() OVER (
 PARTITION BY hospital_id, dept_id, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn
 FROM raw_forecasts) WHERE rn = 1""",
    "last_preds": """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hospital_id, dept_id ORDER BY ts DESC) AS rn
 FROM preds) WHERE rn = 1""",
    "pairs": """
SELECT p.hospital_id, p.dept_id, p.event_id, p.ts, p.horizon, p.predicted,
 date_trunc('hour', p.ts) + to_hours(p.horizon) AS target_ts, o.occupancy_ratio AS actual
FROM (SELECT event_id, hospital_id, dept_id, ts, 1 AS horizon, h1 AS predicted FROM raw_forecasts
 UNION ALL SELECT event_id, hospital_id, dept_id, ts, 2, h2 FROM raw_forecasts
 UNION ALL SELECT event_id, hospital_id, dept_id, ts, 4, h4 FROM raw_forecasts
 UNION ALL SELECT event_id, hospital_id, dept_id, ts, 8, h8 FROM raw_forecasts) p
JOIN occ_1h o ON o.hospital_id = p.hospital_id AND o.dept_id = p.dept_id
 AND o.ts = date_trunc('hour', p.ts) + to_hours(p.horizon)
WHERE p.predicted IS NOT NULL""",
    "alerts": """
SELECT hospital_id, dept_id, ts AS alert_ts, concat('predicted_', CAST(horizon AS string), 'h') AS alert_type,
 'red' AS severity, 0.8::DOUBLE AS threshold, actual AS actual_value, predicted AS predicted_value,
 false AS resolved FROM pairs WHERE predicted >= 0.8::DOUBLE""",
}

LABEL = "CASE WHEN {0} < 0.6 THEN 'green' WHEN {0} < 0.8 THEN 'amber' ELSE 'red' END"
LOSS = """avg(CASE WHEN actual > 0.8 AND predicted < actual THEN 3.0 ELSE 1.0 END * (predicted - actual) * (predicted - actual))
 + 0.5 * avg(CASE WHEN actual > 0.8 AND predicted < 0.75 THEN 0.8 - predicted ELSE 0.0 END
  + CASE WHEN actual < 0.8 AND predicted > 0.85 THEN 0.2 * (predicted - 0.8) ELSE 0.0 END)"""


def _needs(sql):
    return [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]


def oracle(body, doubles=""):
    """The query with its views in front; the named columns are rounded to 6 digits."""
    used = []

    def visit(sql):
        for name in _needs(sql):
            if name not in used and VIEWS[name] != sql:
                visit(VIEWS[name])
                if name not in used:
                    used.append(name)

    visit(body)
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    cols = ", ".join(f"floor({c} * 1e6 + 0.5) / 1e6 AS {c}" for c in doubles.split())
    if cols:
        body = f"SELECT * REPLACE ({cols}) FROM ({body})"
    return (f"WITH {head} " if head else "") + body


def psi_sql(keys, source):
    """Index over ten equal bins, by unnesting the bins."""
    return f"""
SELECT {keys}, sum((a - e) * ln(a / e)) AS psi FROM (
 SELECT {keys}, CASE WHEN ne = 0 THEN 1e-8 ELSE ne / (n + 1e-8) END AS e,
  CASE WHEN na = 0 THEN 1e-8 ELSE na / (n + 1e-8) END AS a FROM (
  SELECT {keys}, b, count(*) AS n,
   count(*) FILTER (WHERE predicted >= lo AND (predicted < hi OR (b = 9 AND predicted <= 1))) AS ne,
   count(*) FILTER (WHERE actual >= lo AND (actual < hi OR (b = 9 AND actual <= 1))) AS na
  FROM ({source}) CROSS JOIN (SELECT b, b * 0.1::DOUBLE AS lo, CASE WHEN b = 9 THEN 1.0::DOUBLE ELSE (b + 1) * 0.1::DOUBLE END AS hi
   FROM range(10) t(b)) GROUP BY ALL)) GROUP BY ALL"""

"""Registered queries: windows, joins, census, features, estimators."""

from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.functions import scalar as S
from wardflow.operators import census, context, estimators, features, flow, graph, scans, serve
from wardflow.plans.registry import query
from wardflow.plans.views import FLOW_DOUBLES, asof
from wardflow.sources import feeds, sinks

_VEC = " ".join(f"v{i}" for i in range(10))
_FEATURES = " ".join(C.FEATURES)


def unpack(df, vector="feature_vector", prefix="v", width=10):
    """Array elements as columns, for comparison."""
    rest = [c for c, kind in df.dtypes if not kind.startswith("array")]
    return df.select(*rest, *[F.col(vector)[i].alias(f"{prefix}{i}") for i in range(width)])


@query("agg_arrivals", """
SELECT hospital_id, dept_id, time_bucket(INTERVAL '10 minutes', event_ts) AS window_start, count(*) AS arrival_count,
 avg(expected_los_minutes) AS avg_expected_los, avg(CASE WHEN acuity <= 2 THEN 1.0 ELSE 0.0 END) AS severity_index
FROM pe WHERE event_type = 'arrival' GROUP BY 1, 2, 3""", "avg_expected_los severity_index")
def agg_arrivals(t):
    out = flow.arrivals(t.patients)
    return out.withColumn("window_start", F.col("window.start")).drop("window")


@query("agg_discharges", """
SELECT hospital_id, dept_id, time_bucket(INTERVAL '10 minutes', event_ts) AS window_start, count(*) AS discharge_count,
 avg(actual_los_minutes) AS avg_actual_los FROM pe WHERE event_type = 'discharge' GROUP BY 1, 2, 3""", "avg_actual_los")
def agg_discharges(t):
    out = flow.discharges(t.patients)
    return out.withColumn("window_start", F.col("window.start")).drop("window")


CONTEXT_DOUBLES = "weather_score flu_index traffic_score"


@query("agg_context", "SELECT * FROM ctx_30m", CONTEXT_DOUBLES)
def agg_context(t):
    return t.context_30m


@query("window_bounds", """
SELECT event_id, time_bucket(INTERVAL '10 minutes', event_ts) AS window_start,
 time_bucket(INTERVAL '10 minutes', event_ts) + INTERVAL '10 minutes' AS window_end FROM pe""")
def window_bounds(t):
    w = F.window("event_ts", "10 minutes")
    return t.patients.select("event_id", w.alias("w")).select(
        "event_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"))


@query("flow_features", "SELECT * FROM flow_10m_full", FLOW_DOUBLES)
def flow_features(t):
    return flow.flow_features(t.patients)


@query("join_flow_windows", "SELECT * FROM flow_10m_full", FLOW_DOUBLES)
def join_flow_windows(t):
    return flow.join_flow(flow.arrivals(t.patients), flow.discharges(t.patients))


@query("default_nulls", """
SELECT hospital_id, dept_id, window_end, discharge_count, avg_actual_los, severity_index FROM flow_1h_full""",
       "avg_actual_los severity_index")
def default_nulls(t):
    return t.flow_1h.select("hospital_id", "dept_id", "window_end", "discharge_count", "avg_actual_los", "severity_index")


@query("arrival_rate", "SELECT hospital_id, dept_id, window_end, arrival_count / 1.0::DOUBLE AS arrival_rate FROM flow_1h",
       "arrival_rate")
def arrival_rate(t):
    return t.flow_1h.select("hospital_id", "dept_id", "window_end", "arrival_rate")


@query("hour_cyclic", "SELECT hospital_id, dept_id, window_end, hour_sin, hour_cos FROM flow_10m_full", "hour_sin hour_cos")
def hour_cyclic(t):
    return flow.flow_features(t.patients).select("hospital_id", "dept_id", "window_end", "hour_sin", "hour_cos")


@query("join_context_asof", asof("flow_1h_full", "window_end"), FLOW_DOUBLES + " " + CONTEXT_DOUBLES)
def join_context_asof(t):
    return context.attach_context(t.flow_1h, t.context_30m)


@query("lookup_capacity", """
SELECT p.event_id, p.hospital_id, p.dept_id, coalesce(d.capacity, 10) AS capacity FROM (
 SELECT event_id, hospital_id, CASE WHEN CAST(event_id AS BIGINT) % 9 = 0 THEN concat(dept_id, '_OLD') ELSE dept_id END AS dept_id
 FROM patient_events WHERE dept_id IS NOT NULL) p LEFT JOIN departments d USING (hospital_id, dept_id)""")
def lookup_capacity(t):
    moved = F.when(F.col("event_id").cast("long") % 9 == 0, F.concat("dept_id", F.lit("_OLD"))).otherwise(F.col("dept_id"))
    rows = t.patients.filter(F.col("dept_id").isNotNull()).select("event_id", "hospital_id", moved.alias("dept_id"))
    return census.with_capacity(rows, t.registry)


def renamed_hospitals(t):
    odd = F.col("patient_id").cast("long") % 11 == 0
    return t.patients.withColumn("hospital_id", F.when(odd, "H9").otherwise(F.col("hospital_id")))


_RENAMED = """(SELECT * REPLACE (CASE WHEN CAST(patient_id AS BIGINT) % 11 = 0 THEN 'H9' ELSE hospital_id END AS hospital_id) FROM patient_events)"""


@query("unknown_keys", f"SELECT event_id, hospital_id FROM {_RENAMED} WHERE hospital_id NOT IN (SELECT hospital_id FROM hospitals)")
def unknown_keys(t):
    return serve.unknown_hospitals(renamed_hospitals(t), t.hospitals).select("event_id", "hospital_id")


@query("restrict_hospitals", f"SELECT event_id, hospital_id FROM {_RENAMED} WHERE hospital_id IN ('H1', 'H3') ")
def restrict_hospitals(t):
    wanted = t.hospitals.filter(F.col("hospital_id").isin("H1", "H3", "H77"))
    return serve.restrict_hospitals(renamed_hospitals(t), wanted).select("event_id", "hospital_id")


@query("census_interval_join", "SELECT * FROM census_1h")
def census_interval_join(t):
    return census.census_at_ticks(t.arrivals)


@query("dense_spine", "SELECT hospital_id, dept_id, ordinal, ts, coalesce(arrival_count, 0) AS arrivals FROM spine_1h LEFT JOIN "
       "(SELECT hospital_id, dept_id, window_end AS ts, arrival_count FROM flow_1h) USING (hospital_id, dept_id, ts)")
def dense_spine(t):
    spine = census.dense_spine(t.registry, *t.bounds)
    counts = t.flow_1h.select("hospital_id", "dept_id", F.col("window_end").alias("ts"),
                              F.col("arrival_count").alias("arrivals"))
    return census.fill_spine(spine, counts, ["arrivals"])


@query("census_running", """
SELECT hospital_id, dept_id, ts, net_move, greatest(CAST(sum(net_move) OVER (PARTITION BY hospital_id, dept_id ORDER BY ts) AS BIGINT), 0) AS census
FROM (SELECT hospital_id, dept_id, ts, CAST(sum(delta) AS BIGINT) AS net_move FROM moves GROUP BY 1, 2, 3)""")
def census_running(t):
    return census.running_census(t.patients)


@query("occupancy_ratio", """
SELECT c.*, d.capacity, least(1.0, census / CAST(capacity AS DOUBLE)) AS occupancy_ratio
FROM census_1h c JOIN departments d USING (hospital_id, dept_id)""".replace("d.capacity", "d.capacity"), "occupancy_ratio")
def occupancy_ratio(t):
    return census.occupancy(census.census_at_ticks(t.arrivals), t.registry)


@query("los_deviation", "SELECT hospital_id, dept_id, window_end, avg_actual_los, los_baseline, los_deviation FROM los_1h",
       "avg_actual_los los_baseline los_deviation")
def los_deviation(t):
    return features.los_deviation(t.flow_1h).select(
        "hospital_id", "dept_id", "window_end", "avg_actual_los", "los_baseline", "los_deviation")


@query("avg_wait_time", "SELECT * FROM wait_1h", "avg_wait_time")
def avg_wait_time(t):
    return features.avg_wait(t.patients)


@query("feature_vector", "SELECT * FROM vec_1h", _VEC)
def feature_vector(t):
    return unpack(t.features_1h.select("hospital_id", "dept_id", "window_end", "feature_vector"))


@query("node_matrix", "SELECT * FROM grid_1h", _VEC)
def node_matrix(t):
    return unpack(t.grid)


_STATS = " ".join(f"{p}_{n}" for n in C.FEATURES for p in ("mean", "std"))


@query("feature_stats", "SELECT " + ", ".join(
    f"avg({n}) AS mean_{n}, stddev_pop({n}) AS std_{n}" for n in C.FEATURES) + " FROM feat_1h", _STATS)
def feature_stats(t):
    return features.feature_stats(t.features_1h)


@query("tick_summary", """
SELECT c.*, x.active FROM (SELECT hospital_id, time_bucket(INTERVAL '10 minutes', event_ts) + INTERVAL '10 minutes' AS tick_end,
 count(*) FILTER (WHERE event_type = 'arrival') AS arrivals, count(*) FILTER (WHERE event_type = 'discharge') AS discharges
 FROM pe WHERE event_type <> 'transfer' GROUP BY 1, 2) c
LEFT JOIN (SELECT hospital_id, time_bucket(INTERVAL '10 minutes', ts) + INTERVAL '10 minutes' AS tick_end, arg_max(census, ts) AS active
 FROM (SELECT hospital_id, ts, greatest(CAST(sum(m) OVER (PARTITION BY hospital_id ORDER BY ts) AS BIGINT), 0) AS census FROM (
  SELECT hospital_id, ts, sum(delta) AS m FROM moves GROUP BY 1, 2)) GROUP BY 1, 2) x USING (hospital_id, tick_end)""")
def tick_summary(t):
    return flow.tick_summary(t.patients, census.running_census(t.patients, ["hospital_id"]))


@query("latest_per_key", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hospital_id, dept_id ORDER BY window_end DESC) AS rn
 FROM flow_10m_full) WHERE rn = 1""", FLOW_DOUBLES)
def latest_per_key(t):
    return scans.latest_per_key(flow.flow_features(t.patients), ["hospital_id", "dept_id"], ["window_end"])


@query("arrival_profile", """
SELECT hour(event_ts) AS hour, isodow(event_ts) >= 6 AS weekend, count(*) AS n_arrivals,
 count(DISTINCT CAST(event_ts AS DATE)) AS n_days, count(*) / count(DISTINCT CAST(event_ts AS DATE)) AS arrivals_per_day
FROM pe WHERE event_type = 'arrival' GROUP BY 1, 2""".replace("hour(event_ts) AS hour", "CAST(hour(event_ts) AS INT) AS hour"),
       "arrivals_per_day")
def arrival_profile(t):
    return estimators.arrival_profile(t.patients)


@query("acuity_mix", """
SELECT dept_type, acuity, n, n / sum(n) OVER (PARTITION BY dept_type) AS share FROM (
 SELECT dept_type, acuity, count(*) AS n FROM patient_events JOIN departments USING (hospital_id, dept_id)
 WHERE event_type = 'arrival' GROUP BY 1, 2)""", "share")
def acuity_mix(t):
    return estimators.acuity_mix(t.patients, t.registry)


@query("los_lognormal_fit", """
SELECT acuity, avg(ln(expected_los_minutes)) AS mu, stddev_samp(ln(expected_los_minutes)) AS sigma, count(*) AS n
FROM patient_events WHERE event_type = 'arrival' GROUP BY 1""", "mu sigma")
def los_lognormal_fit(t):
    return estimators.los_lognormal_fit(t.patients)


@query("transition_matrix", """
SELECT source_type, target_type, n, n / sum(n) OVER (PARTITION BY source_type) AS probability FROM (
 SELECT s.dept_type AS source_type, d.dept_type AS target_type, CAST(sum(transfer_count) AS BIGINT) AS n FROM transfers x
 JOIN departments s ON s.dept_id = x.source_dept JOIN departments d ON d.dept_id = x.target_dept GROUP BY 1, 2)""",
       "probability")
def transition_matrix(t):
    return estimators.transition_matrix(t.patients, t.registry)


_TTL = """SELECT 'features' AS kind, hospital_id, dept_id, window_end AS ts FROM flow_1h WHERE window_end > TIMESTAMP '2024-01-31' - INTERVAL 7 DAYS
UNION ALL SELECT 'predictions', hospital_id, dept_id, ts FROM preds WHERE ts > TIMESTAMP '2024-01-31' - INTERVAL 30 DAYS
UNION ALL SELECT 'alerts', hospital_id, dept_id, alert_ts FROM alerts WHERE alert_ts > TIMESTAMP '2024-01-31' - INTERVAL 90 DAYS"""


@query("retain_ttl", _TTL)
def retain_ttl(t):
    from wardflow.plans.batch_serve import alerts
    keep, as_of = C.Retention(), "2024-01-31"

    def kind(name, df, ts, days):
        return sinks.retain(df, ts, as_of, days).select(F.lit(name).alias("kind"), "hospital_id", "dept_id",
                                                        F.col(ts).alias("ts"))

    return (kind("features", t.flow_1h, "window_end", keep.features_days)
            .unionByName(kind("predictions", t.predictions, "ts", keep.predictions_days))
            .unionByName(kind("alerts", alerts(t), "alert_ts", keep.alerts_days)))


@query("active_model", """
SELECT hospital_id, model_version, trained_at, metrics_json, is_active, CAST(json_extract(metrics_json, '$.k') AS INT) AS metric FROM (
 SELECT *, row_number() OVER (PARTITION BY hospital_id ORDER BY trained_at DESC, model_version DESC) AS rn
 FROM model_rows WHERE is_active) WHERE rn = 1""")
def active_model(t):
    return serve.active_model(feeds.model_rows(t.events))


@query("transfer_counts", """
SELECT hospital_id, source_dept_id AS source_dept, target_dept_id AS target_dept, window_end, count(*) AS transfer_count FROM (
 SELECT *, CAST(unnest(generate_series(time_bucket(INTERVAL '10 minutes', event_ts) + INTERVAL '10 minutes',
  time_bucket(INTERVAL '10 minutes', event_ts) + INTERVAL '24 hours', INTERVAL '10 minutes')) AS TIMESTAMP) AS window_end
 FROM pe WHERE event_type = 'transfer') GROUP BY 1, 2, 3, 4""")
def transfer_counts(t):
    return graph.transfer_counts(t.patients, 24 * 60, 10)

"""Registered queries: documents, serving reads, accuracy, drift, alerts."""

from pyspark.sql import functions as F

from wardflow.functions import scalar as S
from wardflow.operators import forecast, graph, monitor, scans, serve
from wardflow.plans.batch_graph import pairs
from wardflow.plans.registry import query
from wardflow.plans.views import LABEL, LOSS, psi_sql
from wardflow.session import shared_dir
from wardflow.sources import feeds, sinks

_H = "horizon_1h horizon_2h horizon_4h horizon_8h"


def _shown(h, digits=4):
    return f"floor(h{h} * 1e{digits} + 0.5) / 1e{digits}"


@query("sink_predictions", f"""
SELECT hospital_id, dept_id, ts AS prediction_ts, {_shown(1)} AS horizon_1h, {_shown(2)} AS horizon_2h, {_shown(4)} AS horizon_4h,
 coalesce({_shown(8)}, 0.0) AS horizon_8h, 0.85::DOUBLE AS confidence, severity_label, '1.0.0' AS model_version FROM preds""", _H)
def sink_predictions(t):
    path = shared_dir(t.spark, "predictions")
    flat = sinks.prediction_rows(forecast.nested_forecasts(t.predictions))
    sinks.upsert_batch(flat, path, 0, "prediction_ts")
    return sinks.read_latest(t.spark, path, ["hospital_id", "dept_id", "prediction_ts"])


@query("sink_prediction_docs", f"""
SELECT p.hospital_id, p.dept_id, d.dept_name, d.dept_type, ts AS prediction_timestamp, {_shown(1)} AS horizon_1h, {_shown(2)} AS horizon_2h,
 {_shown(4)} AS horizon_4h, coalesce({_shown(8)}, 0.0) AS horizon_8h, max_congestion, severity_label, '1.0.0' AS model_version
FROM preds p JOIN departments d ON d.dept_id = p.dept_id""", _H + " max_congestion")
def sink_prediction_docs(t):
    path = shared_dir(t.spark, "docs")
    docs = sinks.prediction_documents(forecast.nested_forecasts(t.predictions), t.registry)
    docs.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path)
    return t.spark.read.schema(docs.schema).json(path)


def alerts(t):
    return monitor.alert_rows(pairs(t))


_ALERT_D = "threshold actual_value predicted_value"


@query("sink_alerts", "SELECT *, true AS indexed FROM alerts", _ALERT_D)
def sink_alerts(t):
    path = shared_dir(t.spark, "alerts")
    sinks.append_batch(sinks.stamp_alerts(alerts(t)), path, 0)
    out = t.spark.read.parquet(path)
    return out.withColumn("indexed", F.col("indexed_at").isNotNull()).drop("indexed_at", "batch_id")


@query("archive_history", "SELECT CAST(window_end AS DATE) AS dt, hospital_id, dept_id, window_end, arrival_count FROM flow_1h")
def archive_history(t):
    path = shared_dir(t.spark, "archive")
    sinks.archive(t.flow_1h.select("hospital_id", "dept_id", "window_end", "arrival_count"), path, "window_end")
    return t.spark.read.parquet(path)


@query("overview_cards", f"""
SELECT h.hospital_id, h.hospital_name, n.n AS n_departments, coalesce({LABEL.format('m')}, 'green') AS severity,
 CAST(floor(coalesce(m, 0) * 100 + 0.5) AS INT) AS percent FROM hospitals h
JOIN (SELECT hospital_id, count(*) AS n FROM departments GROUP BY 1) n USING (hospital_id)
LEFT JOIN (SELECT hospital_id, max(max_congestion) AS m FROM last_preds GROUP BY 1) f
 USING (hospital_id)""".replace(f"coalesce({LABEL.format('m')}, 'green')", f"CASE WHEN m IS NULL THEN 'green' ELSE {LABEL.format('m')} END"))
def overview_cards(t):
    return serve.overview_cards(t.hospitals, serve.hospital_rollup(t.hospitals, t.last_predictions), t.registry)


@query("hospital_rollup", f"""
SELECT hospital_id, hospital_name, CAST(lat AS DOUBLE) AS lat, CAST(lon AS DOUBLE) AS lon, coalesce(m, 0.0) AS hospital_max_congestion,
 {LABEL.format('coalesce(m, 0.0)')} AS hospital_severity FROM hospitals LEFT JOIN (
 SELECT hospital_id, max(max_congestion) AS m FROM last_preds GROUP BY 1) USING (hospital_id)""",
       "lat lon hospital_max_congestion")
def hospital_rollup(t):
    return serve.hospital_rollup(t.hospitals, t.last_predictions)


@query("topology_document", """
SELECT hospital_id, total_departments, CAST(count(*) AS INT) AS n_edges, string_agg(source_dept || '>' || target_dept, ',' ORDER BY ordinal) AS links,
 CAST(sum(coalesce(transfer_count, 0)) AS BIGINT) AS n_transfers
FROM edges LEFT JOIN transfers USING (hospital_id, source_dept, target_dept) JOIN (SELECT hospital_id, CAST(count(*) AS INT) AS total_departments FROM departments GROUP BY 1) USING (hospital_id) GROUP BY 1, 2""")
def topology_document(t):
    seen = serve.restrict_hospitals(t.hospitals, t.patients)
    docs = serve.topology_document(seen, t.registry, graph.with_observed(t.edges, graph.total_transfers(t.patients)))
    links = F.transform("edges", lambda e: F.concat(e["source_dept"], F.lit(">"), e["target_dept"]))
    return docs.select("hospital_id", "total_departments", F.size("edges").alias("n_edges"),
                       F.concat_ws(",", links).alias("links"),
                       F.aggregate("edges", F.lit(0).cast("long"), lambda n, e: n + e["transfer_count"]).alias("n_transfers"))


@query("forecast_document", f"""
SELECT p.hospital_id, d.dept_id, d.dept_name, {_shown(1, 3)} AS f1, {_shown(2, 3)} AS f2, {_shown(4, 3)} AS f4, {_shown(8, 3)} AS f8,
 floor(max_congestion * 1e3 + 0.5) / 1e3 AS max_congestion, severity_label,
 max(floor(max_congestion * 1e3 + 0.5) / 1e3) OVER (PARTITION BY p.hospital_id) AS hospital_max_congestion, c.weather_score,
 {_shown(8, 3)} AS forecast, floor(o.occupancy * 1e3 + 0.5) / 1e3 AS current_occupancy, max(p.ts) OVER (PARTITION BY p.hospital_id) AS prediction_timestamp,
 '8h' AS forecast_horizon, '1.0.0' AS model_version
FROM last_preds p JOIN departments d ON d.dept_id = p.dept_id
LEFT JOIN (SELECT dept_id, arg_max(occupancy_ratio, ts) AS occupancy FROM occ_1h GROUP BY 1) o ON o.dept_id = p.dept_id
LEFT JOIN (SELECT hospital_id, arg_max(weather_score, window_end) AS weather_score FROM ctx_30m GROUP BY 1) c ON c.hospital_id = p.hospital_id""",
       "f1 f2 f4 f8 forecast current_occupancy max_congestion hospital_max_congestion weather_score")
def forecast_document(t):
    newest = t.context_30m.groupBy("hospital_id").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("window_end"))).alias(c)
        for c in ("weather_score", "flu_index", "traffic_score")])
    present = scans.latest_per_key(t.occupancy.select("hospital_id", "dept_id", "ts", "occupancy_ratio"), ["hospital_id", "dept_id"], ["ts"])
    docs = serve.forecast_document(t.hospitals, t.registry, t.last_predictions, newest, present, "8h")
    d = docs.select("hospital_id", "hospital_max_congestion", "prediction_timestamp", "forecast_horizon",
                    F.col("model_info.version").alias("model_version"), F.explode("departments").alias("d"))
    return d.select("hospital_id", "hospital_max_congestion", "prediction_timestamp", "forecast_horizon", "model_version",
                    "d.forecast", "d.current_occupancy", "d.dept_id", "d.dept_name", "d.max_congestion", "d.severity_label",
                    *[S.horizon_score("d.forecasts", f"{h}h", None).alias(f"f{h}") for h in (1, 2, 4, 8)],
                    "d.contributing_factors.weather_score")


@query("history_range", """
SELECT hospital_id, dept_id, ts, occupancy_ratio FROM occ_1h
WHERE ts < TIMESTAMP '2024-01-20 12:00:00' AND ts >= TIMESTAMP '2024-01-18 12:00:00' AND hospital_id = 'H1'""", "occupancy_ratio")
def history_range(t):
    as_of = F.lit("2024-01-20 12:34:56").cast("timestamp_ntz")
    return serve.history_range(t.occupancy, as_of, 48, "H1").select("hospital_id", "dept_id", "ts", "occupancy_ratio")


@query("history_timeline", "SELECT hospital_id, dept_id, ts, floor(occupancy_ratio * 1e3 + 0.5) / 1e3 AS shown FROM occ_1h", "shown")
def history_timeline(t):
    rows = serve.history_timeline(t.occupancy)
    return rows.select("hospital_id", "ts", F.explode("departments").alias("dept_id", "shown"))


@query("peak_department", """
SELECT p.hospital_id, arg_max(d.dept_name, [p.max_congestion, d.ordinal]) AS peak_dept, CAST(floor(max(p.max_congestion) * 100 + 0.5) AS INT) AS percent
FROM last_preds p JOIN departments d ON d.dept_id = p.dept_id GROUP BY 1""".replace(
    "arg_max(d.dept_name, [p.max_congestion, d.ordinal])", "last(d.dept_name ORDER BY p.max_congestion, d.ordinal)"))
def peak_department(t):
    return serve.peak_department(t.last_predictions, t.registry)


@query("top_departments", """
SELECT hospital_id, dept_id, max_congestion, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY hospital_id ORDER BY max_congestion DESC, dept_id) AS INT) AS rank
 FROM last_preds) WHERE rank <= 4""", "max_congestion")
def top_departments(t):
    return serve.top_departments(t.last_predictions).select("hospital_id", "dept_id", "max_congestion", "rank")


@query("join_predictions_actuals", "SELECT * FROM pairs", "predicted actual")
def join_predictions_actuals(t):
    return pairs(t).select("hospital_id", "dept_id", "event_id", "ts", "horizon", "predicted", "target_ts", "actual")


def drift_pairs(t):
    return feeds.prediction_pairs(t.events)


RECENT = """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY hospital_id ORDER BY ts DESC, event_id DESC) AS rn
 FROM prediction_pairs) WHERE rn <= 288"""


def newest():
    return [F.col("ts").desc(), F.col("event_id").desc()]


@query("rolling_recent", RECENT, "predicted actual")
def rolling_recent(t):
    return monitor.recent(drift_pairs(t), ["hospital_id"], newest())


@query("psi", psi_sql("hospital_id", "SELECT * FROM prediction_pairs"), "psi")
def psi(t):
    return monitor.psi(drift_pairs(t), ["hospital_id"])


@query("mae", "SELECT hospital_id, avg(abs(predicted - actual)) AS mae FROM prediction_pairs GROUP BY 1", "mae")
def mae(t):
    return monitor.mae(drift_pairs(t), ["hospital_id"])


@query("congestion_loss", f"SELECT hospital_id, {LOSS} AS loss FROM prediction_pairs GROUP BY 1", "loss")
def congestion_loss(t):
    return monitor.congestion_loss(drift_pairs(t), ["hospital_id"])


DRIFT = f"""
SELECT hospital_id, CASE WHEN n < 50 THEN 'insufficient_data' WHEN psi > 0.2 OR mae / 0.045::DOUBLE > 2 THEN 'drift_detected' ELSE 'stable' END AS status,
 CASE WHEN n >= 50 THEN floor(psi * 1e4 + 0.5) / 1e4 END AS psi, CASE WHEN n >= 50 THEN floor(mae * 1e4 + 0.5) / 1e4 END AS rolling_mae,
 CASE WHEN n >= 50 THEN floor(mae / 0.045::DOUBLE * 100 + 0.5) / 100 END AS mae_ratio, n AS records_checked FROM (
 SELECT hospital_id, count(*) AS n, avg(abs(predicted - actual)) AS mae FROM ({RECENT}) GROUP BY 1)
JOIN ({psi_sql("hospital_id", RECENT)}) USING (hospital_id)"""


@query("drift_status", DRIFT, "psi rolling_mae mae_ratio")
def drift_status(t):
    return monitor.drift_status(drift_pairs(t), ["hospital_id"], newest())


@query("alerts_from_predictions", "SELECT * FROM alerts", _ALERT_D)
def alerts_from_predictions(t):
    return alerts(t)


@query("alert_resolution", """
SELECT * EXCLUDE (resolved), resolved_ts IS NOT NULL AS resolved FROM (SELECT a.*, (
 SELECT min(o.ts) FROM occ_1h o WHERE o.dept_id = a.dept_id AND o.ts > a.alert_ts AND o.occupancy_ratio < 0.8) AS resolved_ts FROM alerts a)""",
       _ALERT_D)
def alert_resolution(t):
    return monitor.alert_resolution(alerts(t), t.occupancy)

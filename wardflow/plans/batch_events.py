"""Registered queries: decoding, validation, scalar expressions, unions."""

from pyspark.sql import functions as F

from wardflow import schemas
from wardflow.functions import scalar as S
from wardflow.operators import context
from wardflow.operators import events as E
from wardflow.plans.registry import query
from wardflow.sources import codec, topology

_PATIENT = ("event_id event_type hospital_id dept_id patient_id acuity arrival_ts discharge_ts transfer_ts "
            "source_dept_id target_dept_id expected_los_minutes actual_los_minutes").split()
_LOS = "expected_los_minutes actual_los_minutes"


def broken_json(df, key="hospital_id"):
    """Envelopes of the feed; one payload in fifty is cut off."""
    value = codec.encode(df.select("*", F.col("event_id").alias("_id")), "_id")
    return value.select(F.when(F.col("key").cast("long") % 50 == 3, F.lit("{\"event_id\": "))
                        .otherwise(F.col("value")).alias("value"))


DECODED_PATIENTS = "SELECT " + ", ".join(
    f"CASE WHEN CAST(event_id AS BIGINT) % 50 <> 3 THEN {c} END AS {c}" for c in _PATIENT) + " FROM patient_events"


@query("decode_patient_json", DECODED_PATIENTS, _LOS)
def decode_patient_json(t):
    raw = broken_json(t.patients.drop("event_ts"))
    return codec.without_zone(codec.decode(raw, schemas.PATIENT_EVENT))


_CONTEXT = ("event_id event_type hospital_id event_ts temperature_c precipitation is_severe weather_score flu_index "
            "congestion_score avg_speed_kmh")
CONTEXT_VALUES = "temperature_c precipitation weather_score flu_index congestion_score avg_speed_kmh"


DECODED_CONTEXT = "SELECT " + ", ".join(
    f"CASE WHEN CAST(event_id AS BIGINT) % 50 <> 3 THEN {c} END AS {'timestamp' if c == 'event_ts' else c}"
    for c in _CONTEXT.split()) + " FROM context_events"


@query("decode_context_json", DECODED_CONTEXT, CONTEXT_VALUES)
def decode_context_json(t):
    raw = broken_json(t.signals.withColumnRenamed("event_ts", "timestamp"))
    out = codec.without_zone(codec.decode(raw, schemas.CONTEXT_EVENT))
    return out.drop("trend")


@query("encode_keyed_json", """
SELECT hospital_id AS key, event_id, event_type, patient_id, acuity IS NULL AS acuity_left_out FROM patient_events""")
def encode_keyed_json(t):
    rows = codec.encode(t.patients.drop("event_ts"))
    value = F.col("value")
    return rows.select("key", *[F.get_json_object(value, f"$.{c}").alias(c)
                                for c in ("event_id", "event_type", "patient_id")],
                       F.get_json_object(value, "$.acuity").isNull().alias("acuity_left_out"))


BAD_SQL = """SELECT * REPLACE (
 CASE WHEN CAST(event_id AS BIGINT) % 50 = 0 THEN 9 ELSE acuity END AS acuity,
 CASE WHEN CAST(event_id AS BIGINT) % 50 = 1 AND expected_los_minutes IS NOT NULL THEN -1.0 ELSE expected_los_minutes END AS expected_los_minutes,
 CASE WHEN CAST(event_id AS BIGINT) % 50 = 1 AND actual_los_minutes IS NOT NULL THEN -1.0 ELSE actual_los_minutes END AS actual_los_minutes,
 CASE WHEN CAST(event_id AS BIGINT) % 50 <> 3 OR event_type <> 'transfer' THEN patient_id END AS patient_id,
 CASE WHEN CAST(event_id AS BIGINT) % 50 <> 2 THEN hospital_id END AS hospital_id) FROM patient_events"""

ERRORS_SQL = f"""SELECT *, concat_ws('; ',
 CASE WHEN hospital_id IS NULL THEN 'hospital_id missing' END,
 CASE WHEN event_type <> 'arrival' AND patient_id IS NULL THEN 'patient_id missing' END,
 CASE WHEN event_type <> 'discharge' AND acuity NOT BETWEEN 1 AND 5 THEN 'acuity not in 1..5' END,
 CASE WHEN event_type = 'arrival' AND expected_los_minutes <= 0 THEN 'expected_los_minutes not positive' END,
 CASE WHEN event_type = 'discharge' AND actual_los_minutes <= 0 THEN 'actual_los_minutes not positive' END) AS error
FROM ({BAD_SQL})"""


def bad_patients(t):
    """The feed with some rules broken by id; all rows are kept."""
    i = F.col("event_id").cast("long") % 50
    df = t.patients.drop("event_ts")
    los = {c: F.when((i == 1) & F.col(c).isNotNull(), -1.0).otherwise(F.col(c)) for c in _LOS.split()}
    return df.withColumns({"acuity": F.when(i == 0, 9).otherwise(F.col("acuity")), **los,
                           "patient_id": F.when((i != 3) | (F.col("event_type") != "transfer"), F.col("patient_id")),
                           "hospital_id": F.when(i != 2, F.col("hospital_id"))})


BAD_CONTEXT_SQL = """SELECT *, concat_ws('; ', CASE WHEN precipitation IS NULL AND event_type = 'weather' THEN 'precipitation missing' END,
 CASE WHEN avg_speed_kmh < 0 THEN 'avg_speed_kmh negative' END) AS error FROM (
 SELECT * REPLACE (CASE WHEN CAST(event_id AS BIGINT) % 50 <> 4 THEN precipitation END AS precipitation,
  CASE WHEN CAST(event_id AS BIGINT) % 50 = 5 THEN -avg_speed_kmh - 1 ELSE avg_speed_kmh END AS avg_speed_kmh) FROM context_events)"""


def bad_signals(t):
    i = F.col("event_id").cast("long") % 50
    return t.signals.withColumns({"precipitation": F.when(i != 4, F.col("precipitation")),
                                  "avg_speed_kmh": F.when(i == 5, -F.col("avg_speed_kmh") - 1).otherwise(F.col("avg_speed_kmh"))})


@query("validate_events", f"SELECT event_id, event_type, error AS errors FROM ({ERRORS_SQL}) "
       f"UNION ALL SELECT event_id, event_type, error FROM ({BAD_CONTEXT_SQL})")
def validate_events(t):
    names = ["event_id", "event_type", "errors"]
    out = E.validate(bad_patients(t), E.patient_rules()).select(*names).unionByName(
        E.validate(bad_signals(t), E.context_rules()).select(*names))
    return out.select("event_id", "event_type", F.concat_ws("; ", "errors").alias("errors"))


@query("dead_letter_split", f"""
SELECT 'ed.patient.events' AS original_topic, hospital_id AS key, event_id, event_type, error,
 patient_id AS payload_patient FROM ({ERRORS_SQL}) WHERE error <> ''""")
def dead_letter_split(t):
    _, dead = E.dead_letter_split(bad_patients(t), E.patient_rules(), codec.topic_of("patient"))
    return dead.select("original_topic", "key", "event_id", "event_type", "error",
                       F.get_json_object("value", "$.patient_id").alias("payload_patient"))


@query("reject_counts", f"""
SELECT rule, event_type, count(*) AS n_rejected FROM (
 SELECT event_type, unnest(string_split(error, '; ')) AS rule FROM ({ERRORS_SQL}) WHERE error <> '')
GROUP BY 1, 2""")
def reject_counts(t):
    _, dead = E.dead_letter_split(bad_patients(t), E.patient_rules(), codec.topic_of("patient"))
    return E.reject_counts(dead)


@query("publish_events", f"""
SELECT 'ed.patient.events' AS topic, hospital_id AS key, event_id, event_type FROM ({ERRORS_SQL}) WHERE error = ''
UNION ALL SELECT 'ed.dead.letter', hospital_id, event_id, event_type FROM ({ERRORS_SQL}) WHERE error <> ''
UNION ALL SELECT CASE WHEN error = '' THEN 'ed.context.events' ELSE 'ed.dead.letter' END, hospital_id, event_id, event_type
FROM ({BAD_CONTEXT_SQL})""")
def publish_events(t):
    sent = codec.publish(bad_patients(t), E.patient_rules(), codec.topic_of("patient")).unionByName(
        codec.publish(bad_signals(t), E.context_rules(), codec.topic_of("context")))
    return sent.select("topic", "key", F.get_json_object("value", "$.event_id").alias("event_id"),
                       F.get_json_object("value", "$.event_type").alias("event_type"))


@query("doc_unified_events", """
SELECT event_type, hospital_id, dept_id, patient_id, acuity, event_ts,
 coalesce(actual_los_minutes, expected_los_minutes) AS los_minutes FROM pe""", "los_minutes")
def doc_unified_events(t):
    return E.unified_documents(t.patients)


@query("unify_event_time", "SELECT event_id, event_ts FROM pe")
def unify_event_time(t):
    return t.patients.select("event_id", "event_ts")


@query("filter_event_type", "SELECT event_id, hospital_id, dept_id, arrival_ts FROM patient_events WHERE event_type = 'arrival'")
def filter_event_type(t):
    return E.of_kind(t.patients, "arrival").select("event_id", "hospital_id", "dept_id", "arrival_ts")


@query("severity_flag", "SELECT event_id, CASE WHEN acuity <= 2 THEN 1 ELSE 0 END AS severe FROM patient_events")
def severity_flag(t):
    return t.patients.select("event_id", S.severe_case("acuity").alias("severe"))


@query("severity_label", "SELECT event_id, CASE WHEN predicted < 0.6 THEN 'green' WHEN predicted < 0.8 THEN 'amber' "
       "ELSE 'red' END AS label FROM prediction_pairs")
def severity_label(t):
    return pairs(t).select("event_id", S.severity_label("predicted").alias("label"))


def pairs(t):
    from wardflow.sources import feeds
    return feeds.prediction_pairs(t.events)


@query("clip_unit", """
SELECT event_id, floor(greatest(0.0, least(1.0, value / 100 - 0.1)) * 1000 + 0.5) / 1000 AS shown3,
 floor(greatest(0.0, least(1.0, value / 100 - 0.1)) * 10000 + 0.5) / 10000 AS shown4 FROM events""", "shown3 shown4")
def clip_unit(t):
    x = S.clip_unit(F.col("value") / 100 - 0.1)
    return t.events.select("event_id", S.display_round(x, 3).alias("shown3"), S.display_round(x, 4).alias("shown4"))


@query("zscore_fixed", """
SELECT event_id, (predicted - 0.5) / 0.2 AS z_predicted, (actual - 0.5) / 0.2 AS z_actual FROM prediction_pairs""",
       "z_predicted z_actual")
def zscore_fixed(t):
    return pairs(t).select("event_id", *[S.zscore(c, 0.5, 0.2).alias(f"z_{c}") for c in ("predicted", "actual")])


@query("max_horizon", "SELECT event_id, greatest(h1, h2, h4, h8) AS peak FROM raw_forecasts", "peak")
def max_horizon(t):
    return t.raw_forecasts.select("event_id", S.peak_horizon("h1", "h2", "h4", "h8").alias("peak"))


@query("forecast_map", """
SELECT event_id, h1 AS f1, h2 AS f2, h4 AS f4, coalesce(h8, 0.0) AS f8, 0.0::DOUBLE AS f12 FROM raw_forecasts""",
       "f1 f2 f4 f8 f12")
def forecast_map(t):
    m = t.raw_forecasts.withColumn("m", S.forecast_map("h1", "h2", "h4", "h8"))
    return m.select("event_id", *[S.horizon_score("m", f"{h}h").alias(f"f{h}") for h in (1, 2, 4, 8, 12)])


@query("pct_display", "SELECT event_id, CAST(floor(coalesce(h8, 0) * 100 + 0.5) AS INT) AS percent FROM raw_forecasts")
def pct_display(t):
    return t.raw_forecasts.select("event_id", S.percent("h8").alias("percent"))


@query("dept_label", """
SELECT event_id, id AS dept_id, coalesce(label, split_part(id, '_', -1)) AS label FROM (
 SELECT event_id, CASE WHEN event_id % 10 = 0 THEN concat(dept_id, '_X', CAST(event_id % 4 AS string)) ELSE dept_id END AS id
 FROM raw_forecasts) LEFT JOIN (VALUES ('TRIAGE','Triage'),('RESUS','Resus'),('FASTTRACK','Fast Track'),('OBS','Obs'),
 ('RADIOLOGY','Radiology'),('BOARDING','Boarding'),('DISCHARGE','Discharge')) AS n(suffix, label)
 ON n.suffix = split_part(id, '_', -1)""")
def dept_label(t):
    odd = F.concat("dept_id", F.lit("_X"), (F.col("event_id") % 4).cast("string"))
    rows = t.raw_forecasts.select("event_id", F.when(F.col("event_id") % 10 == 0, odd)
                                  .otherwise(F.col("dept_id")).alias("dept_id"))
    return rows.withColumn("label", S.dept_label("dept_id"))


@query("parse_dept_filter", """
SELECT event_id, dept_id FROM (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'all' ELSE 'H1_TRIAGE,H2_OBS,H3_RESUS,H4_NONE' END AS request
 FROM raw_forecasts) WHERE request = 'all' OR list_contains(string_split(request, ','), dept_id)""")
def parse_dept_filter(t):
    asked = F.when(F.col("event_id") % 3 == 0, "all").otherwise("H1_TRIAGE,H2_OBS,H3_RESUS,H4_NONE")
    rows = t.raw_forecasts.withColumn("request", asked)
    return rows.filter(S.wanted_dept("dept_id", "request")).select("event_id", "dept_id")


@query("elapsed_minutes", """
SELECT event_id, greatest(1.0, (epoch_us(TIMESTAMP '2024-01-16') - epoch_us(arrival_ts)) / 6e7) AS minutes
FROM patient_events WHERE event_type = 'arrival'""", "minutes")
def elapsed_minutes(t):
    now = F.lit("2024-01-16").cast("timestamp_ntz")
    return t.arrivals.select("event_id", S.elapsed_minutes("arrival_ts", now).alias("minutes"))


@query("expected_discharge", """
SELECT event_id, arrival_ts + to_microseconds(CAST(floor(expected_los_minutes * 6e7) AS BIGINT)) AS expected_discharge_ts
FROM patient_events WHERE event_type = 'arrival'""")
def expected_discharge(t):
    return t.arrivals.select("event_id", S.add_minutes("arrival_ts", "expected_los_minutes").alias("expected_discharge_ts"))


@query("weather_score", """
SELECT event_id, floor(greatest(0.0, least(1.0, precipitation / 15 + CASE WHEN precipitation > 10 THEN 0.3::DOUBLE ELSE 0.0 END))
 * 1000 + 0.5) / 1000 AS score FROM context_events WHERE event_type = 'weather'""", "score")
def weather_score(t):
    rows = t.signals.filter(F.col("event_type") == "weather")
    score = S.weather_score("precipitation", S.severe_weather("precipitation"))
    return rows.select("event_id", S.display_round(score, 3).alias("score"))


@query("severe_weather_flag", "SELECT event_id, precipitation > 10 AS severe FROM context_events WHERE event_type = 'weather'")
def severe_weather_flag(t):
    return (t.signals.filter(F.col("event_type") == "weather")
            .select("event_id", S.severe_weather("precipitation").alias("severe")))


@query("flu_trend", """
SELECT event_id, hospital_id, flu_index, previous, CASE WHEN flu_index - previous > 0.5 THEN 'rising'
 WHEN flu_index - previous < -0.5 THEN 'falling' ELSE 'stable' END AS trend FROM (
 SELECT *, lag(flu_index) OVER (PARTITION BY hospital_id ORDER BY event_ts, event_id) AS previous
 FROM context_events WHERE event_type = 'flu_index')""", "flu_index previous")
def flu_trend(t):
    return context.flu_trend(t.signals).drop("event_ts")


@query("rush_hour", """
SELECT event_id, (hour(event_ts) >= 7 AND hour(event_ts) < 9) OR (hour(event_ts) >= 17 AND hour(event_ts) < 19) AS rush
FROM context_events WHERE event_type = 'traffic'""")
def rush_hour(t):
    return (t.signals.filter(F.col("event_type") == "traffic")
            .select("event_id", S.rush_hour("event_ts").alias("rush")))


@query("road_speed", """
SELECT event_id, floor(greatest(5.0, 80.0::DOUBLE * (1.0::DOUBLE - congestion_score)) * 10 + 0.5) / 10 AS kmh
FROM context_events WHERE event_type = 'traffic'""", "kmh")
def road_speed(t):
    return (t.signals.filter(F.col("event_type") == "traffic")
            .select("event_id", S.display_round(S.road_speed("congestion_score"), 1).alias("kmh")))


@query("weekend_flag", "SELECT event_id, isodow(ts) >= 6 AS weekend FROM events")
def weekend_flag(t):
    return t.events.select("event_id", S.weekend("ts").alias("weekend"))


@query("geo_location", """
SELECT dept_id, lat, lon, count(*) AS n_events FROM raw_forecasts JOIN departments USING (hospital_id, dept_id)
GROUP BY ALL""", "lat lon")
def geo_location(t):
    n = t.raw_forecasts.groupBy("hospital_id", "dept_id").agg(F.count("*").alias("n_events"))
    point = n.join(t.registry, ["hospital_id", "dept_id"]).withColumn("geo_location", S.geo_point("lat", "lon"))
    return point.select("dept_id", "geo_location.lat", "geo_location.lon", "n_events")


@query("union_event_kinds", """
SELECT event_id, event_type, hospital_id, acuity, flu_index FROM (
 SELECT event_id, event_type, hospital_id, acuity, NULL::DOUBLE AS flu_index FROM patient_events
 UNION ALL SELECT event_id, event_type, hospital_id, NULL::INT, flu_index FROM context_events)""", "flu_index")
def union_event_kinds(t):
    kinds = [E.of_kind(t.patients, k).select("event_id", "event_type", "hospital_id", "acuity")
             for k in ("arrival", "discharge", "transfer")]
    kinds += [E.of_kind(t.signals, k).select("event_id", "event_type", "hospital_id", "flu_index")
              for k in ("weather", "flu_index", "traffic")]
    return E.union_kinds(*kinds)


# Registry tables, next to what the feed shows of them.

@query("dim_hospitals", """
SELECT h.hospital_id, h.hospital_name, CAST(h.lat AS DOUBLE) AS lat, CAST(h.lon AS DOUBLE) AS lon, count(p.event_id) AS n_events
FROM hospitals h LEFT JOIN patient_events p USING (hospital_id) GROUP BY ALL""", "lat lon")
def dim_hospitals(t):
    n = t.patients.groupBy("hospital_id").agg(F.count("*").alias("n"))
    return (t.hospitals.join(n, "hospital_id", "left")
            .select("hospital_id", "hospital_name", "lat", "lon", F.coalesce("n", F.lit(0)).alias("n_events")))


@query("dim_departments", """
SELECT d.*, count(p.event_id) AS n_events FROM departments d LEFT JOIN patient_events p
 ON p.hospital_id = d.hospital_id AND p.dept_id = d.dept_id GROUP BY ALL""", "lat lon")
def dim_departments(t):
    n = t.patients.groupBy("hospital_id", "dept_id").agg(F.count("*").alias("n"))
    return (t.registry.join(n, ["hospital_id", "dept_id"], "left")
            .withColumn("n_events", F.coalesce("n", F.lit(0))).drop("n"))


@query("dim_edges", """
SELECT e.*, coalesce(t.transfer_count, 0) AS n_transfers FROM edges e LEFT JOIN transfers t USING (hospital_id, source_dept, target_dept)""",
       "base_weight")
def dim_edges(t):
    from wardflow.operators import graph
    n = graph.total_transfers(t.patients)
    return (topology.edges(t.spark).join(n, graph.PAIR, "left")
            .withColumn("n_transfers", F.coalesce("transfer_count", F.lit(0))).drop("transfer_count"))

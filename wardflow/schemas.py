"""Declared schemas. Nothing is inferred from JSON."""

from pyspark.sql import types as T


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _D, _I, _B, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.BooleanType(), T.TimestampType()

PATIENT_EVENT = _struct(
    ("event_id", _S), ("event_type", _S), ("hospital_id", _S), ("dept_id", _S), ("patient_id", _S),
    ("acuity", _I), ("arrival_ts", _TS), ("discharge_ts", _TS), ("transfer_ts", _TS),
    ("source_dept_id", _S), ("target_dept_id", _S),
    ("expected_los_minutes", _D), ("actual_los_minutes", _D),
)

CONTEXT_EVENT = _struct(
    ("event_id", _S), ("event_type", _S), ("hospital_id", _S), ("timestamp", _TS),
    ("temperature_c", _D), ("precipitation", _D), ("is_severe", _B), ("weather_score", _D),
    ("flu_index", _D), ("trend", _S), ("congestion_score", _D), ("avg_speed_kmh", _D),
)

FEATURE_WINDOW = _struct(
    ("hospital_id", _S), ("dept_id", _S), ("window_end", _TS),
    ("arrival_count", T.LongType()), ("discharge_count", T.LongType()), ("arrival_rate", _D),
    ("avg_expected_los", _D), ("avg_actual_los", _D), ("severity_index", _D),
    ("hour_sin", _D), ("hour_cos", _D),
)

CONTEXT_WINDOW = _struct(
    ("hospital_id", _S), ("window_end", _TS), ("weather_score", _D), ("flu_index", _D),
    ("traffic_score", _D), ("is_severe_weather", _I),
)

# A Kafka-shaped row, also used by the file stand-ins for topics.
ENVELOPE = T.StructType([
    T.StructField("key", T.StringType(), True),
    T.StructField("value", T.StringType(), True),
])

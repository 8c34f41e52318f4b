"""Scalar expressions on event, feature and forecast columns."""

import math
from functools import reduce

from pyspark.sql import functions as F

from wardflow import config as C


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def event_time(*cols):
    """First known time of an event."""
    return F.coalesce(*[_col(c) for c in (cols or ("arrival_ts", "discharge_ts", "transfer_ts"))])


def severe_case(acuity):
    """1 for acuity 1 and 2, else 0. An unknown acuity counts as not severe."""
    return F.when(_col(acuity) <= 2, 1).otherwise(0)


def severity_label(score):
    score = _col(score)
    return (F.when(score < C.AMBER_FROM, "green")
            .when(score < C.RED_FROM, "amber")
            .otherwise("red"))


def display_round(x, digits):
    """Half-up rounding on the binary double, so that every engine gives the same digits."""
    scale = float(10 ** digits)
    return F.floor(_col(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def clip_unit(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _col(x)))


def zscore(x, mean, std):
    return (_col(x) - F.lit(float(mean))) / F.lit(max(float(std), 1e-8))


def zscore_vector(vec, means=C.FEATURE_MEAN, stds=C.FEATURE_STD):
    """z-scores of a fixed-width array, unrolled so that it stays in generated code."""
    vec = _col(vec)
    return F.array(*[zscore(vec[i], m, s) for i, (m, s) in enumerate(zip(means, stds))])


def peak_horizon(*cols):
    return F.greatest(*[_col(c) for c in cols])


def forecast_map(*cols):
    labels = F.array(*[F.lit(x) for x in C.HORIZON_LABELS])
    return F.map_from_arrays(labels, F.array(*[_col(c) for c in cols]))


def horizon_score(forecasts, label, default=0.0):
    return F.coalesce(F.try_element_at(_col(forecasts), F.lit(label)), F.lit(default))


def percent(score):
    return F.floor(F.coalesce(_col(score), F.lit(0.0)) * 100 + 0.5).cast("int")


# Short department names shown for an id suffix.
DEPT_LABELS = {
    "TRIAGE": "Triage", "RESUS": "Resus", "FASTTRACK": "Fast Track", "OBS": "Obs",
    "RADIOLOGY": "Radiology", "BOARDING": "Boarding", "DISCHARGE": "Discharge",
}


def dept_label(dept_id):
    """Short name for a known suffix; any other id shows the text after its last underscore."""
    suffix = F.substring_index(_col(dept_id), "_", -1)
    known = F.create_map(*[F.lit(x) for pair in DEPT_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix), suffix)


def wanted_dept(dept_id, request):
    """True for the ids of a comma list; 'all' keeps every department."""
    request = _col(request)
    return (request == "all") | F.array_contains(F.split(request, ","), _col(dept_id))


def micros(ts):
    """Microseconds since 1970 of a timestamp with or without zone (UTC session)."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def from_micros(us):
    return F.timestamp_micros(us).cast("timestamp_ntz")


def elapsed_minutes(start, end):
    return F.greatest(F.lit(1.0), (micros(end) - micros(start)) / F.lit(6e7))


def add_minutes(ts, minutes):
    return from_micros(micros(ts) + F.floor(_col(minutes) * F.lit(6e7)).cast("long"))


def severe_weather(precipitation):
    return _col(precipitation) > 10


def weather_score(precipitation, severe):
    boost = F.when(_col(severe), 0.3).otherwise(0.0)
    return clip_unit(F.least(F.lit(1.0), _col(precipitation) / 15 + boost))


def rush_hour(ts):
    h = F.hour(_col(ts))
    return ((h >= 7) & (h < 9)) | ((h >= 17) & (h < 19))


def road_speed(congestion):
    return F.greatest(F.lit(5.0), F.lit(80.0) * (F.lit(1.0) - _col(congestion)))


def weekend(ts):
    return F.dayofweek(_col(ts)).isin(1, 7)


def geo_point(lat, lon):
    return F.struct(_col(lat).alias("lat"), _col(lon).alias("lon"))


def hour_sin(ts):
    return F.sin(F.lit(2 * math.pi) * F.hour(_col(ts)) / F.lit(24))


def hour_cos(ts):
    return F.cos(F.lit(2 * math.pi) * F.hour(_col(ts)) / F.lit(24))


def feature_vector(names=C.FEATURES):
    """Named features as one array in fixed order; what is unknown becomes 0."""
    return F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names])


def vector_or_zeros(vec, width=len(C.FEATURES)):
    """The array itself when it has the right width, else zeros (also for NULL)."""
    zeros = F.array(*[F.lit(0.0)] * width)
    return F.when(F.size(_col(vec)) == width, _col(vec)).otherwise(zeros)


def json_text(*cols):
    """The columns as one JSON text, times with all six digits; NULL columns are left out."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return F.to_json(F.struct(*cols), {"timestampFormat": pattern, "timestampNTZFormat": pattern})


def add_all(cols):
    return reduce(lambda a, b: a + b, cols)

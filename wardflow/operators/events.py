"""Validation, reject path and unions of event kinds."""

from functools import reduce

from pyspark.sql import functions as F

from wardflow.functions import scalar as S


def _rule(name, broken):
    """`broken` is a condition; NULL counts as broken only where the condition says so."""
    return name, F.coalesce(broken, F.lit(False))


# Fixed values of the event schemas: field, the kinds it is required in, and its bound (a text for the
# rule's name, least, greatest; `positive` excludes 0). A missing value breaks a two-sided bound.
PATIENT_KINDS, CONTEXT_KINDS = ("arrival", "discharge", "transfer"), ("weather", "flu_index", "traffic")
PATIENT_FIELDS = (
    ("dept_id", ("arrival", "discharge"), None),
    ("arrival_ts", ("arrival",), None),
    ("patient_id", ("discharge", "transfer"), None),
    ("discharge_ts", ("discharge",), None),
    ("transfer_ts", ("transfer",), None),
    ("source_dept_id", ("transfer",), None),
    ("target_dept_id", ("transfer",), None),
    ("acuity", ("arrival", "transfer"), ("not in 1..5", 1, 5)),
    ("expected_los_minutes", ("arrival",), ("not positive", 0, None)),
    ("actual_los_minutes", ("discharge",), ("not positive", 0, None)),
)
CONTEXT_FIELDS = (
    ("temperature_c", ("weather",), None),
    ("precipitation", ("weather",), ("negative", 0, None)),
    ("weather_score", ("weather",), ("not in 0..1", 0, 1)),
    ("flu_index", ("flu_index",), ("not in 0..10", 0, 10)),
    ("congestion_score", ("traffic",), ("not in 0..1", 0, 1)),
    ("avg_speed_kmh", ("traffic",), ("negative", 0, None)),
)


def _rules(kinds, fields, always):
    """Rules of a field table: kind known, fields of every kind, missing fields, then bounds."""
    kind = F.col("event_type")
    rules = [_rule("event_type unknown", kind.isNull() | ~kind.isin(*kinds))]
    rules += [_rule(name, F.col(c).isNull()) for name, c in always]
    for field, where, bound in fields:
        if bound is None or bound[2] is None:
            rules.append(_rule(f"{field} missing", kind.isin(*where) & F.col(field).isNull()))
    for field, where, bound in fields:
        if bound is not None:
            text, low, high = bound
            value = F.col(field)
            broken = (value.isNull() | ~value.between(low, high) if high is not None
                      else value <= low if text == "not positive" else value < low)
            rules.append(_rule(f"{field} {text}", kind.isin(*where) & broken))
    return rules


def patient_rules():
    return _rules(PATIENT_KINDS, PATIENT_FIELDS, [("hospital_id missing", "hospital_id")])


def context_rules(ts="event_ts"):
    return _rules(CONTEXT_KINDS, CONTEXT_FIELDS, [("hospital_id missing", "hospital_id"), ("time missing", ts)])


def validate(df, rules):
    """Adds `errors`, the names of the broken rules in rule order."""
    names = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules])
    return df.withColumn("errors", F.filter(names, lambda x: x.isNotNull()))


def dead_letter_split(df, rules, topic, key="hospital_id"):
    """(valid rows, reject rows). Both sides are filters over the same narrow plan."""
    checked = validate(df, rules)
    ok = checked.filter(F.size("errors") == 0).drop("errors")
    payload = S.json_text(*df.columns)
    dead = checked.filter(F.size("errors") > 0).select(
        F.lit(topic).alias("original_topic"), F.col(key).alias("key"), payload.alias("value"),
        F.concat_ws("; ", "errors").alias("error"), "event_id", "event_type", "errors")
    return ok, dead


def reject_counts(dead):
    """Rejects by rule and event kind."""
    return (dead.select(F.explode("errors").alias("rule"), "event_type")
            .groupBy("rule", "event_type").agg(F.count("*").alias("n_rejected")))


def union_kinds(*frames):
    """Event kinds of different shape in one wide table; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unify_event_time(df):
    return df.withColumn("event_ts", S.event_time())


def of_kind(df, kind):
    return df.filter(F.col("event_type") == kind)


def unified_documents(df):
    """Search view of events: one time and one length of stay for all kinds."""
    return df.select(
        "event_type", "hospital_id", "dept_id", "patient_id", "acuity",
        S.event_time().alias("event_ts"),
        F.coalesce("actual_los_minutes", "expected_los_minutes").alias("los_minutes"))

"""Stores, replays, retention, reject path."""

import datetime as dt

from pyspark.sql import functions as F
from test_scans import same

from wardflow import schemas
from wardflow.operators import events as E
from wardflow.plans.batch_events import bad_patients
from wardflow.sources import codec, sinks

T0 = dt.datetime(2024, 1, 1, 23, 50)
ROWS = "hospital_id string, dept_id string, window_ts timestamp_ntz, n int"


def rows(spark, *items):
    return spark.createDataFrame([("H1", d, T0 + dt.timedelta(minutes=m), n) for d, m, n in items], ROWS)


def current(spark, path, **kw):
    out = sinks.read_latest(spark, path, ["hospital_id", "dept_id", "window_ts"], **kw)
    return sorted((r.dept_id, r.window_ts.day, r.n) for r in out.collect())


def test_upsert_replay_and_compaction(spark, tmp_path):
    path, folded = str(tmp_path / "store"), str(tmp_path / "folded")
    sinks.upsert_batch(rows(spark, ("a", 0, 1), ("a", 10, 1), ("b", 0, 1)), path, 0, "window_ts")
    sinks.upsert_batch(rows(spark, ("a", 0, 5), ("c", 20, 7)), path, 1, "window_ts")
    want = [("a", 1, 5), ("a", 2, 1), ("b", 1, 1), ("c", 2, 7)]
    assert current(spark, path) == want
    sinks.upsert_batch(rows(spark, ("a", 0, 5), ("c", 20, 7)), path, 1, "window_ts")  # replay
    assert current(spark, path) == want
    assert spark.read.parquet(path).count() == 5
    assert current(spark, path, dates=["2024-01-02"]) == [("a", 2, 1), ("c", 2, 7)]
    sinks.compact(spark, path, folded, ["hospital_id", "dept_id", "window_ts"], "window_ts")
    assert current(spark, folded) == want and spark.read.parquet(folded).count() == 4


def test_date_filter_prunes_folders(spark, tmp_path):
    path = str(tmp_path / "store")
    sinks.upsert_batch(rows(spark, ("a", 0, 1), ("a", 10, 1)), path, 0, "window_ts")
    plan = sinks.read_latest(spark, path, ["hospital_id"], ["2024-01-02"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [dt" in plan.replace("isnotnull(dt", "dt")


def test_append_replay_and_topic_round_trip(spark, tables, tmp_path):
    path = str(tmp_path / "topic")
    feed = tables.patients.drop("event_ts")
    for _ in range(2):
        sinks.write_topic(feed, path, 3)
        sinks.append_batch(feed, str(tmp_path / "rows"), 3)
    back = codec.without_zone(codec.decode(spark.read.parquet(path), schemas.PATIENT_EVENT))
    same(back, feed)
    assert spark.read.parquet(str(tmp_path / "rows")).count() == feed.count()


def test_retention_is_strict_at_the_edge(spark):
    df = rows(spark, ("a", 0, 1), ("a", 1, 2))
    as_of = (T0 + dt.timedelta(days=7)).isoformat()
    assert [r.n for r in sinks.retain(df, "window_ts", as_of, 7).collect()] == [2]


def test_archive_keeps_every_row_by_day(spark, tables, tmp_path):
    path = str(tmp_path / "archive")
    sinks.archive(tables.flow_1h, path, "window_end")
    back = spark.read.parquet(path)
    same(back.drop("dt"), tables.flow_1h)
    assert back.filter(F.col("dt") != F.to_date("window_end")).count() == 0


def test_split_is_complete_and_disjoint(spark, tables):
    feed = bad_patients(tables)
    ok, dead = E.dead_letter_split(feed, E.patient_rules(), "ed.patient.events")
    assert ok.count() + dead.count() == feed.count() and dead.count() > 0
    assert ok.join(dead, "event_id").count() == 0
    back = codec.without_zone(codec.decode(dead, schemas.PATIENT_EVENT))
    same(back, feed.join(dead.select("event_id"), "event_id", "left_semi"))


def test_context_rules(spark):
    cols = "event_id string, event_type string, hospital_id string, event_ts timestamp_ntz, precipitation double, " \
           "weather_score double, flu_index double, congestion_score double, temperature_c double, avg_speed_kmh double"
    df = spark.createDataFrame([
        ("1", "weather", "H1", T0, 0.0, 1.0, None, None, 9.0, None), ("2", "weather", "H1", T0, -0.1, 1.1, None, None, 9.0, None),
        ("3", "flu_index", "H1", T0, None, None, 10.5, None, None, None), ("4", "traffic", "H1", None, None, None, None, 0.5, None, 50.0),
        ("5", "snow", None, T0, None, None, None, None, None, None), ("6", "traffic", "H1", T0, None, None, None, None, None, 0.0),
        ("7", "weather", "H1", T0, None, 0.5, None, None, None, None), ("8", "traffic", "H1", T0, None, None, None, 0.5, None, -1.0),
        ("9", "traffic", "H1", T0, None, None, None, 0.5, None, None)], cols)
    got = {r.event_id: r.errors for r in E.validate(df, E.context_rules()).collect()}
    assert got == {"1": [], "2": ["precipitation negative", "weather_score not in 0..1"], "3": ["flu_index not in 0..10"],
                   "4": ["time missing"], "5": ["event_type unknown", "hospital_id missing"],
                   "6": ["congestion_score not in 0..1"], "7": ["temperature_c missing", "precipitation missing"],
                   "8": ["avg_speed_kmh negative"], "9": ["avg_speed_kmh missing"]}

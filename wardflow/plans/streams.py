"""Registered queries: streams over the events table, each equal to its batch twin."""

import datetime as dt

from pyspark.sql import functions as F

from wardflow import config as C
from wardflow import schemas
from wardflow.operators import events as E
from wardflow.plans.batch_events import CONTEXT_VALUES, DECODED_CONTEXT, DECODED_PATIENTS, broken_json
from wardflow.plans.batch_serve import DRIFT, newest
from wardflow.plans.registry import query
from wardflow.plans.views import FLOW_DOUBLES
from wardflow.plans.views import flow as flow_sql
from wardflow.plans.views import flow_full
from wardflow.session import shared_dir, tuned
from wardflow.sources import codec, feeds, sinks, store, streams, topic_writer
from wardflow.streaming import jobs, state, windows

NOW = {"availableNow": True}
KEYS = ["hospital_id", "dept_id", "window_end"]
CONTEXT_DOUBLES = "weather_score flu_index traffic_score"


CLOSING = "~closing"  # hospital of the rows that only move event time on


class Live:
    """The events table as a stream, in a session with this library's streaming settings."""

    def __init__(self, t, closing=False, **options):
        self.spark, self.main, self.sf_dir, self.closing = tuned(t.spark), t.spark, t.sf_dir, closing
        self.schema = t.events.schema
        self.events = feeds.stream_events(self.spark, self.sf_dir, self.schema, **options)
        if closing:
            self.events = self.events.unionByName(self._closing_rows(t.events))

    def _closing_rows(self, events):
        """One row per event kind, two days after the newest, so that every window closes (append mode)."""
        path, newest_ = shared_dir(self.main, "closing"), events.groupBy("event_type").agg(F.max("ts").alias("ts")).collect()
        last = max((r["ts"] for r in newest_ if r["ts"] is not None), default=dt.datetime(2000, 1, 1))
        rows = [(-1 - i, last + dt.timedelta(days=2), -1, k, 0.0, None)
                for i, k in enumerate(("signup", "purchase", "click", "view", "error"))]
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(path)
        return self.spark.readStream.schema(self.schema).parquet(path)

    @property
    def patients(self):
        return self._marked(E.unify_event_time(feeds.patient_events(self.events)))

    @property
    def signals(self):
        return self._marked(feeds.context_events(self.events))

    def _marked(self, df):
        """Closing rows have ids below 0; they get a hospital of their own."""
        own = F.col("event_id").cast("long") < 0
        return df.withColumn("hospital_id", F.when(own, CLOSING).otherwise(F.col("hospital_id"))) if self.closing else df

    def dir(self, name):
        return shared_dir(self.main, name)

    def read(self, path):
        """What a finished query wrote, without zone and without the closing rows, if there were any."""
        df = codec.without_zone(self.main.read.parquet(path))
        return df.filter(~F.col("hospital_id").eqNullSafe(F.lit(CLOSING))) if self.closing else df

    def to_files(self, df):
        """Run an append-mode query to its end and read its files."""
        out = self.dir("out")
        jobs.finish(jobs.start_files(df, out, self.dir("ckpt"), NOW))
        return self.read(out)

    def run(self, df, body, mode="update"):
        return jobs.finish(jobs.start(df, body, self.dir("ckpt"), mode, trigger=NOW))[0]

    def to_store(self, df, keys, ts=None):
        """Run an update-mode query into the keyed store and read the current rows."""
        store = self.dir("store")
        self.run(df, jobs.fanout(lambda b, i: sinks.upsert_batch(b, store, i, ts)))
        return codec.without_zone(sinks.read_latest(self.main, store, keys))


def _broken_topic(live, df):
    """A topic in which one payload in fifty is cut off."""
    topic = live.dir("topic")
    broken_json(df).select(F.lit(None).cast("string").alias("key"), "value").write.parquet(f"{topic}/batch_id=0")
    return topic


@query("src_patient_events", DECODED_PATIENTS, "expected_los_minutes actual_los_minutes")
def src_patient_events(t):
    live = Live(t)
    topic = _broken_topic(live, t.patients.drop("event_ts"))
    raw = streams.patient_source(live.spark, {"path": topic}, "parquet")
    return live.to_files(codec.decode(raw, schemas.PATIENT_EVENT))


@query("src_context_events", DECODED_CONTEXT, CONTEXT_VALUES)
def src_context_events(t):
    live = Live(t)
    topic = _broken_topic(live, t.signals.withColumnRenamed("event_ts", "timestamp"))
    raw = streams.context_source(live.spark, {"path": topic}, "parquet")
    return live.to_files(codec.decode(raw, schemas.CONTEXT_EVENT)).drop("trend")


@query("bounded_intake", "SELECT event_id, event_type, hospital_id, event_ts FROM pe")
def bounded_intake(t):
    live = Live(t)
    topic = live.dir("topic")
    sinks.write_topic(t.patients.drop("event_ts").repartition(4), topic, 0)
    raw = streams.patient_source(live.spark, {"path": topic, "maxFilesPerTrigger": "1"}, "parquet")
    rows = E.unify_event_time(codec.decode(raw, schemas.PATIENT_EVENT))
    return live.to_files(rows.select("event_id", "event_type", "hospital_id", "event_ts"))


@query("sink_feature_topic", "SELECT * FROM flow_10m_full", FLOW_DOUBLES)
def sink_feature_topic(t):
    live = Live(t)
    topic = live.dir("topic")
    live.run(windows.patient_windows(live.patients),
             jobs.fanout(lambda df, i: topic_writer.publish_batch(df, topic, i)))
    return codec.without_zone(codec.decode(topic_writer.read_topic(t.spark, topic), schemas.FEATURE_WINDOW))


@query("sink_context_topic", "SELECT * FROM ctx_30m", CONTEXT_DOUBLES)
def sink_context_topic(t):
    live = Live(t)
    topic = live.dir("topic")
    live.run(windows.context_windows(live.signals),
             jobs.fanout(lambda df, i: topic_writer.publish_batch(df, topic, i)))
    return codec.without_zone(codec.decode(topic_writer.read_topic(t.spark, topic), schemas.CONTEXT_WINDOW))


@query("sink_feature_store", "SELECT * RENAME (window_end AS window_ts) FROM flow_10m_full", FLOW_DOUBLES)
def sink_feature_store(t):
    """Micro-batches are appended, then merged into the days they touch; the snapshot is read."""
    live = Live(t)
    rows = windows.patient_windows(live.patients).withColumnRenamed("window_end", "window_ts")
    path, keys = live.dir("store"), ["hospital_id", "dept_id", "window_ts"]
    live.run(rows, jobs.fanout(lambda df, i: store.write_batch(df, path, i)))
    store.merge(live.main, path, keys, "window_ts")
    return codec.without_zone(store.Snapshot(live.main, path).read(keys, "window_ts"))


@query("fanout_batch", "SELECT 'store' AS sink, hospital_id, dept_id, window_end, arrival_count FROM flow_10m "
       "UNION ALL SELECT 'topic', hospital_id, dept_id, window_end, arrival_count FROM flow_10m")
def fanout_batch(t):
    live = Live(t)
    store, topic = live.dir("store"), live.dir("topic")
    live.run(windows.patient_windows(live.patients), jobs.feature_writers(store, topic))
    a = sinks.read_latest(t.spark, store, ["hospital_id", "dept_id", "window_ts"]).withColumnRenamed("window_ts", "window_end")
    b = codec.decode(t.spark.read.parquet(topic), schemas.FEATURE_WINDOW)
    cols = [*KEYS, "arrival_count"]
    return codec.without_zone(a.select(F.lit("store").alias("sink"), *cols)
                              .unionByName(b.select(F.lit("topic").alias("sink"), *cols)))


@query("stream_patient_windows", "SELECT * FROM flow_10m_full", FLOW_DOUBLES)
def stream_patient_windows(t):
    live = Live(t, closing=True)
    return live.to_files(windows.patient_windows(live.patients))


@query("stream_context_windows", "SELECT * FROM ctx_30m", CONTEXT_DOUBLES)
def stream_context_windows(t):
    live = Live(t, closing=True)
    return live.to_files(windows.context_windows(live.signals))


_SLIDING = flow_full("(" + " UNION ALL ".join(
    flow_sql("1 hour").replace("time_bucket(INTERVAL '1 hour', event_ts)",
                               f"time_bucket(INTERVAL '1 hour', event_ts + INTERVAL '{m} minutes') - INTERVAL '{m} minutes'")
    for m in (0, 30)) + ")")


@query("stream_sliding_windows", _SLIDING, FLOW_DOUBLES)
def stream_sliding_windows(t):
    live = Live(t, closing=True)
    cfg = C.FlowConfig(window="1 hour", slide="30 minutes")
    return live.to_files(windows.patient_windows(live.patients, cfg))


@query("stream_flow_join", "SELECT * FROM flow_10m_full", FLOW_DOUBLES)
def stream_flow_join(t):
    live = Live(t, closing=True)
    return live.to_files(windows.flow_join(live.patients))


@query("stream_dedup", "SELECT event_id, event_type, hospital_id, event_ts FROM pe")
def stream_dedup(t):
    live, again = Live(t), Live(t)
    resent = again.patients.filter(F.col("event_id").cast("long") % 20 == 0)
    rows = windows.deduplicated(live.patients.unionByName(resent))
    return live.to_files(rows.select("event_id", "event_type", "hospital_id", "event_ts"))


@query("stream_hourly_rollup", """
SELECT hospital_id, dept_id, time_bucket(INTERVAL '1 hour', event_ts) + INTERVAL '1 hour' AS window_end,
 count(*) FILTER (WHERE event_type = 'arrival') AS arrival_count, count(*) FILTER (WHERE event_type = 'discharge') AS discharge_count
FROM pe WHERE event_type <> 'transfer' GROUP BY 1, 2, 3""")
def stream_hourly_rollup(t):
    live = Live(t, closing=True)
    return live.to_files(windows.hourly_rollup(live.patients))


@query("join_context_interval", """
SELECT p.event_id, p.hospital_id, p.event_ts, c.window_end AS context_ts, c.weather_score, c.flu_index, c.traffic_score, c.is_severe_weather
FROM pe p LEFT JOIN ctx_30m c ON c.hospital_id = p.hospital_id AND c.window_end = time_bucket(INTERVAL '30 minutes', p.event_ts)""",
       CONTEXT_DOUBLES)
def join_context_interval(t):
    live = Live(t, closing=True)
    events = live.patients.select("event_id", "hospital_id", "event_ts")
    return live.to_files(windows.join_context_interval(events, live.signals))


@query("stream_static_enrich", """
SELECT p.event_id, p.hospital_id, p.dept_id, d.dept_name, d.dept_type, d.capacity FROM pe p LEFT JOIN departments d USING (hospital_id, dept_id)""")
def stream_static_enrich(t):
    from wardflow.sources import topology
    live = Live(t)
    rows = live.patients.select("event_id", "hospital_id", "dept_id")
    return live.to_files(windows.enrich(rows, topology.departments(live.spark)))


@query("stream_census", """
SELECT hospital_id, dept_id, CAST(sum(delta) AS BIGINT) AS net, max(ts) AS moved_at, greatest(CAST(sum(delta) AS BIGINT), 0) AS census
FROM moves GROUP BY 1, 2""")
def stream_census(t):
    live = Live(t)
    return live.to_store(state.live_census(live.patients), ["hospital_id", "dept_id"])


@query("stream_overdue_patients", """
SELECT hospital_id, patient_id, dept_id, event_id, arrival_ts, expected_end FROM (
 SELECT *, lead(event_ts) OVER (PARTITION BY hospital_id, patient_id ORDER BY event_ts, event_id) AS next_ts,
  arrival_ts + to_microseconds(CAST(floor(expected_los_minutes * 6e7) AS BIGINT)) AS expected_end
 FROM pe WHERE event_type <> 'transfer') WHERE event_type = 'arrival' AND (next_ts IS NULL OR next_ts >= expected_end)""")
def stream_overdue_patients(t):
    live = Live(t, closing=True)
    return live.to_files(state.overdue_stream(live.patients))


@query("stream_drift", f"SELECT * FROM ({DRIFT}) WHERE status = 'drift_detected'", "psi rolling_mae mae_ratio")
def stream_drift(t):
    live = Live(t)
    held, requests = live.dir("state"), live.dir("requests")
    live.run(feeds.prediction_pairs(live.events),
             jobs.drift_body(live.spark, held, requests, ["hospital_id"], newest()), mode="append")
    return t.spark.read.parquet(requests).drop("batch_id")  # the requests of all batches


@query("stream_alerts", """
SELECT hospital_id, dept_id, ts AS alert_ts, concat('predicted_', CAST(horizon AS string), 'h') AS alert_type, 'red' AS severity,
 predicted AS predicted_value, false AS resolved FROM (
 SELECT hospital_id, dept_id, ts, 1 AS horizon, h1 AS predicted FROM raw_forecasts UNION ALL SELECT hospital_id, dept_id, ts, 2, h2 FROM raw_forecasts
 UNION ALL SELECT hospital_id, dept_id, ts, 4, h4 FROM raw_forecasts UNION ALL SELECT hospital_id, dept_id, ts, 8, h8 FROM raw_forecasts)
WHERE predicted >= 0.8::DOUBLE""", "predicted_value")
def stream_alerts(t):
    live = Live(t)
    out = live.to_files(jobs.alert_stream(feeds.raw_forecasts(live.events)))
    return out.drop("indexed_at", "actual_value", "threshold")


def _pair_of_queries(t, watch=None):
    """Both feature queries side by side, each with its own checkpoint."""
    live = Live(t)
    watched = watch and watch(live)
    names = ("patients", "context")
    stores = [live.dir(n) for n in names]
    frames = (windows.patient_windows(live.patients), windows.context_windows(live.signals))
    queries = [jobs.start(df, jobs.fanout(lambda b, i, s=store: sinks.upsert_batch(b, s, i, "window_end")),
                          live.dir("ckpt"), name=f"{name}-{store[-6:]}", trigger=NOW)
               for name, store, df in zip(names, stores, frames)]
    return stores, jobs.finish(*queries), watched


@query("stream_triggers", """
SELECT 'context' AS feed, count(*) AS n_windows FROM ctx_30m UNION ALL SELECT 'patients', count(*) FROM flow_10m""")
def stream_triggers(t):
    stores, *_ = _pair_of_queries(t)
    keys = (["hospital_id", "dept_id", "window_end"], ["hospital_id", "window_end"])
    counts = [sinks.read_latest(t.spark, s, k).groupBy().agg(F.count("*").alias("n_windows"))
              .select(F.lit(n).alias("feed"), "n_windows")
              for s, k, n in zip(stores, keys, ("patients", "context"))]
    return counts[0].unionByName(counts[1])


@query("stream_health", """
SELECT feed, count(*) AS input_rows, CAST(0 AS BIGINT) AS late_rows, true AS has_watermark
FROM events CROSS JOIN (VALUES ('patients'), ('context')) AS f(feed) GROUP BY 1""")
def stream_health(t):
    """The counts of the report; its rates and durations differ from run to run."""
    _, queries, progress = _pair_of_queries(t, lambda live: jobs.ProgressLog(live.spark, live.dir("progress")))
    report = progress.report(*queries)
    progress.close()
    return report.groupBy(F.substring_index("name", "-", 1).alias("feed")).agg(
        F.sum("input_rows").alias("input_rows"), F.sum("late_rows").alias("late_rows"),
        (F.max("watermark") > "2000").alias("has_watermark"))

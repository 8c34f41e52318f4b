"""Streams over several time-ordered files: equality with batch, late rows, duplicates, restarts."""

import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from test_scans import same

from wardflow.config import FlowConfig
from wardflow.operators import census, context, events as E, flow, monitor
from wardflow.plans.batch_serve import newest
from wardflow.session import tuned
from wardflow.sources import codec, feeds, sinks
from wardflow.streaming import jobs, state, windows

NOW = {"availableNow": True}


def put(df, folder, order):
    """One parquet file per call, with a modification time that follows `order`."""
    part = str(folder) + f"-part{order}"
    df.coalesce(1).write.parquet(part)
    os.makedirs(folder, exist_ok=True)
    name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
    target = os.path.join(folder, f"{order:03d}.parquet")
    shutil.copyfile(os.path.join(part, name), target)
    os.utime(target, (1_700_000_000 + order * 10,) * 2)


def closing(spark, schema):
    import datetime as dt
    rows = [(-1 - i, dt.datetime(2030, 1, 1), -1, k, 0.0, None)
            for i, k in enumerate(("signup", "purchase", "click", "view", "error"))]
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def feed(spark, tables, tmp_path):
    """The events in four time-ordered files plus the closing rows."""
    folder = tmp_path / "feed"
    ranked = tables.events.withColumn("part", F.ntile(4).over(__import__("pyspark").sql.Window.orderBy("ts", "event_id")))
    for i in range(1, 5):
        put(ranked.filter(F.col("part") == i).drop("part"), folder, i)
    put(closing(spark, tables.events.schema), folder, 9)
    return str(folder)


class Job:
    def __init__(self, spark, tables, folder, tmp_path):
        self.spark, self.tmp = tuned(spark), tmp_path
        self.events = (self.spark.readStream.schema(tables.events.schema).option("maxFilesPerTrigger", 1)
                       .parquet(folder))
        self.patients = E.unify_event_time(feeds.patient_events(self.events))
        self.signals = feeds.context_events(self.events)

    def path(self, name):
        return str(self.tmp / name)

    def files(self, df, name="out"):
        q = jobs.finish(jobs.start_files(df, self.path(name), self.path(name + "-ckpt"), NOW))[0]
        return q, codec.without_zone(self.spark.read.parquet(self.path(name)))

    def store(self, df, keys, ts=None, name="store"):
        body = jobs.fanout(lambda b, i: sinks.upsert_batch(b, self.path(name), i, ts))
        q = jobs.finish(jobs.start(df, body, self.path(name + "-ckpt"), trigger=NOW))[0]
        return q, codec.without_zone(sinks.read_latest(self.spark, self.path(name), keys))


@pytest.fixture()
def job(spark, tables, feed, tmp_path):
    return Job(spark, tables, feed, tmp_path)


def rounded(df):
    return (df.filter(F.col("hospital_id") != "H0")
            .withColumns({n: F.round(n, 6) for n, t in df.dtypes if t == "double"}))


def test_flow_in_append_and_update_mode(job, tables):
    want = rounded(flow.flow_features(tables.patients))
    q, got = job.files(windows.patient_windows(job.patients))
    assert len([p for p in q.recentProgress if p["numInputRows"]]) == 5
    same(rounded(got), want)
    _, got = job.store(windows.patient_windows(job.patients), ["hospital_id", "dept_id", "window_end"], "window_end")
    same(rounded(got), want)


def test_flow_join_in_append_mode(job, tables):
    cfg = FlowConfig(window="1 hour", slide="1 hour")
    _, got = job.files(windows.flow_join(job.patients, cfg))
    same(rounded(got), rounded(flow.flow_features(tables.patients, "1 hour")))


def test_flow_join_is_refused_in_update_mode(job):
    with pytest.raises(AnalysisException):
        jobs.start(windows.flow_join(job.patients), jobs.fanout(), job.path("no"), trigger=NOW)


def test_context_windows(job, tables):
    _, got = job.files(windows.context_windows(job.signals))
    same(rounded(got), rounded(context.context_windows(tables.signals)))


def test_hourly_rollup_over_batches(job, tables):
    _, got = job.files(windows.hourly_rollup(job.patients))
    want = flow.flow_features(tables.patients, "1 hour", keep_all=True).select(*got.columns)
    same(got.filter("hospital_id <> 'H0'"), want)


def test_interval_join_over_batches(job, tables):
    ev = job.patients.select("event_id", "hospital_id", "event_ts")
    _, got = job.files(windows.join_context_interval(ev, job.signals))
    c = context.context_windows(tables.signals).withColumnRenamed("hospital_id", "h").withColumnRenamed("window_end", "context_ts")
    e = tables.patients.select("event_id", "hospital_id", "event_ts")
    slot = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("event_ts").cast("timestamp")) / 1800) * 1800).cast("timestamp_ntz")
    want = e.join(c, (F.col("hospital_id") == F.col("h")) & (F.col("context_ts") == slot), "left").drop("h")
    assert want.count() == e.count()  # one context row per event at most
    same(rounded(got.select(*want.columns)), rounded(want))


def test_census_and_overdue_over_batches(job, tables):
    _, got = job.store(state.live_census(job.patients), ["hospital_id", "dept_id"])
    net = census.movements(tables.patients).groupBy("hospital_id", "dept_id").agg(F.sum("delta").alias("net"))
    same(got.filter("hospital_id <> 'H0'").select("hospital_id", "dept_id", "net"), net)
    _, late = job.files(state.overdue_stream(job.patients), "late")
    want = census.overdue_patients(tables.patients)
    same(late.filter("hospital_id <> 'H0'").select(*want.columns), want)
    body = state.overdue_body(job.spark, job.path("held"), job.path("body"))
    jobs.finish(jobs.start(job.patients, body, job.path("body-ckpt"), "append", trigger=NOW))
    got = codec.without_zone(job.spark.read.parquet(job.path("body")))
    same(got.filter("hospital_id <> 'H0'").select(*want.columns), want)


def _arrivals(spark, rows):
    """Patient events of one hospital and department from (minute, patient, event_id, kind, expected minutes)."""
    import datetime as dt
    start = dt.datetime(2024, 5, 1)
    return spark.createDataFrame([("H1", "H1_OBS", p, i, k, start + dt.timedelta(minutes=m), los) for m, p, i, k, los in rows],
                                 "hospital_id string, dept_id string, patient_id string, event_id string, event_type string, "
                                 "event_ts timestamp_ntz, expected_los_minutes double")


def test_overdue_restarts_and_forgets(job, spark, tmp_path):
    """Stopped between two files, started again from the checkpoint: the same reports. State holds what is due
    and nothing that no stay can reach."""
    parts = [[(0, "a", "01", "arrival", 100.0), (50, "a", "02", "discharge", None), (5, "b", "03", "arrival", 30.0),
              (10, "c", "04", "arrival", 500.0), (0, "d", "05", "arrival", 60.0), (60, "d", "06", "arrival", 20.0)],
             [(300, "c", "07", "discharge", None), (295, "f", "08", "arrival", 2000.0), (290, "e", "09", "arrival", 5.0),
              (293, "e", "10", "arrival", 5.0), (293, "e", "11", "discharge", None)],
             [(900, "z", "90", "discharge", None)], [(1500, "z", "91", "discharge", None)]]
    folder = tmp_path / "in"
    schema = _arrivals(spark, []).schema

    def run(upto):
        for i, rows in enumerate(parts[:upto]):
            if not (folder / f"{i:03d}.parquet").exists():
                put(_arrivals(spark, rows), folder, i)
        stream = job.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
        _, got = job.files(state.overdue_stream(stream), "restart")
        return sorted(got.select("event_id").toPandas()["event_id"])

    assert run(1) == ["03"]  # the watermark, ten minutes behind, is at minute 50
    assert run(2) == ["03", "05", "06"]  # at 290; 06 itself comes when 05 is due, not before
    assert run(4) == ["03", "05", "06"]  # at 1490; 04, 09 and 10 ended in time, 08 is not due
    held = job.spark.read.format("statestore").option("path", job.path("restart-ckpt"))
    due = held.option("stateVarName", "due").load().selectExpr("key.patient_id p", "explode(user_map_value.stays) s").selectExpr("p", "s.id")
    assert [tuple(r) for r in due.collect()] == [("f", "08")]
    moves = held.option("stateVarName", "moves").load().selectExpr("key.patient_id p", "explode(user_map_value.found) m").selectExpr("p", "m.id")
    assert {tuple(r) for r in moves.collect()} == {("f", "08"), ("z", "91")}


class Held:
    """One patient's state variables and timers in memory; `calls` counts what would be calls to Spark's state."""

    def __init__(self):
        self.vars, self.timers, self.calls = {}, set(), 0

    def getMapState(self, name, *_):
        return Held.Var(self, self.vars.setdefault(name, {}))

    def getValueState(self, name, *_):
        return Held.Var(self, self.vars.setdefault(name, {}), ())

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    class Var:
        def __init__(self, handle, values, key=None):
            self.handle, self.values, self.key = handle, values, key

        def __getattr__(self, name):
            self.handle.calls += 1
            return {"getValue": self.values.get, "get": lambda: self.values.get(self.key), "exists": lambda: self.key in self.values,
                    "updateValue": self.values.__setitem__, "update": lambda v: self.values.__setitem__(self.key, v),
                    "removeKey": lambda k: self.values.pop(k, None)}[name]


def _reports(batches):
    """(state, reports per batch) of one patient; a batch is (watermark in ms, rows of (us, id, expected_us or None))."""
    from types import SimpleNamespace as Thing
    held, processor, out = Held(), state.OverdueProcessor(), []
    processor.init(held)
    for now, rows in batches:
        times = Thing(getCurrentWatermarkInMs=lambda now=now: now)
        if rows:
            list(processor.handleInputRows(("H1", "p"), iter([
                Thing(event_us=us, event_id=i, dept_id="D", expected_us=until, event_type="discharge" if until is None else "arrival")
                for us, i, until in rows]), times))
        found = []
        for at in sorted(t for t in held.timers if t <= now):
            found += processor.handleExpiredTimer(("H1", "p"), times, Thing(getExpiryTimeInMs=lambda at=at: at))
            held.timers.discard(at)
        out.append(sorted(r.event_id for r in found))
    return held, out


def _overdue(rows):
    rows = sorted(rows)
    return sorted(i for n, (us, i, until) in enumerate(rows)
                  if until is not None and (n + 1 == len(rows) or rows[n + 1][0] >= until))


def test_overdue_calls_of_the_state_do_not_follow_the_rows():
    """Thirty moves in as many days: 534 calls when every move had its own entries and timers, 8 now."""
    day = 86_400_000_000
    rows = [(n * day, f"{n:02d}", None if n % 3 else n * day + 3_600_000_000 * (1 + n)) for n in range(30)]
    held, out = _reports([(0, rows), (100 * day // 1000, [])])
    assert out == [[], _overdue(rows)] and held.calls < 20
    assert not held.timers and not any(held.vars.values())


def test_overdue_of_a_busy_patient():
    """More moves than a slot takes, unsorted and in several batches: the same reports, and slots get narrower."""
    import random
    rnd, minute = random.Random(7), 60_000_000
    span, batches, everything = 10 * 1440, [], []
    for b in range(4):
        rows = []
        for n in range(13_000 if b % 2 == 0 else 40):
            us = (b * span + 1 + rnd.randrange(span)) * minute + rnd.choice([0, 0, 1, 500])
            rows.append((us, f"{b}{n:05d}", rnd.choice([None, us, us + rnd.choice([1, 5, 600]) * minute, us + 2 * span * minute])))
        everything += rows
        batches.append(((b * span) * minute // 1000, rows))
    held, out = _reports(batches)
    assert sorted(sum(out, [])) == [i for i in _overdue(everything) if next(r[2] for r in everything if r[1] == i) <= 3 * span * minute]
    assert all(len(v[0]) <= 4_000 for v in held.vars["moves"].values()) and len(held.vars["moves"]) > 2
    assert min(m[0] for v in held.vars["moves"].values() for m in v[0]) > 2 * span * minute  # older ones are gone
    held, out = _reports([*batches, (10 * span * minute // 1000, [])])
    assert sorted(sum(out, [])) == _overdue(everything)
    assert not held.timers and not any(held.vars.values())


def test_overdue_of_an_hour_that_comes_in_two_files(job, spark, tmp_path):
    """A stay is reported in the batch whose watermark reaches its end exactly; the other one ends in time."""
    folder = tmp_path / "hour"
    put(_arrivals(spark, [(0, "a", "01", "arrival", 20.0), (1, "b", "02", "arrival", 40.0)]), folder, 0)
    put(_arrivals(spark, [(20, "a", "03", "arrival", 1.0), (30, "b", "04", "discharge", None)]), folder, 1)
    put(_arrivals(spark, [(100, "c", "05", "discharge", None)]), folder, 2)
    stream = job.spark.readStream.schema(_arrivals(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    seen = {}
    jobs.finish(jobs.start(state.overdue_stream(stream), lambda df, i: seen.update({i: sorted(r.event_id for r in df.collect())}),
                           job.path("c"), "append", trigger=NOW))
    assert [v for _, v in sorted(seen.items()) if v] == [["01"], ["03"]]


def test_drift_over_batches_equals_one_check(job, tables):
    held, requests, seen = job.path("held"), job.path("requests"), []
    body = jobs.drift_body(job.spark, held, requests, ["hospital_id"], newest(),
                           on_drift=lambda df, i: seen.append((i, df.count())))
    pairs = feeds.prediction_pairs(job.events.filter("user_id >= 0"))
    q = jobs.finish(jobs.start(pairs, body, job.path("c"), "append", trigger=NOW))[0]
    last = q.lastProgress["batchId"]
    want = monitor.drift_status(feeds.prediction_pairs(tables.events), ["hospital_id"], newest())
    same(job.spark.read.parquet(f"{requests}/batch_id={last}"), want.filter("status = 'drift_detected'"))
    assert last >= 3 and all(n > 0 for _, n in seen)  # called only where there is drift

    def fails(df, i):
        raise ValueError("no")
    jobs.drift_body(job.spark, job.path("held2"), job.path("requests2"), ["hospital_id"], newest(), on_drift=fails)(
        feeds.prediction_pairs(tables.events), 0)  # a failing callback stops nothing
    # the same batch again starts from the same state and gives the same records
    before = job.spark.read.parquet(f"{held}/batch={last}").toPandas()
    body(tables.events.limit(0).transform(feeds.prediction_pairs), last + 1)
    after = job.spark.read.parquet(f"{held}/batch={last + 1}").toPandas()
    key = ["hospital_id", "event_id"]
    assert before.sort_values(key).event_id.tolist() == after.sort_values(key).event_id.tolist()


def test_late_rows_are_dropped_and_counted(spark, tables, tmp_path):
    """Every 40th event arrives with the last file, long past the watermark."""
    folder = tmp_path / "late"
    late = F.col("event_id") % 40 == 0
    put(tables.events.filter(~late), folder, 1)
    put(closing(spark, tables.events.schema), folder, 2)
    put(tables.events.filter(late), folder, 3)
    job = Job(spark, tables, str(folder), tmp_path)
    q, got = job.files(windows.patient_windows(job.patients))
    kept = E.unify_event_time(feeds.patient_events(tables.events.filter(~late)))
    same(rounded(got), rounded(flow.flow_features(kept)))
    report = jobs.health(spark, q)
    assert report.agg(F.sum("late_rows").alias("n")).first().n > 0
    assert report.agg(F.sum("input_rows").alias("n")).first().n == tables.events.count() + 5


def test_resent_ids_across_batches(spark, tables, tmp_path):
    folder = tmp_path / "twice"
    put(tables.events, folder, 1)
    put(tables.events.filter(F.col("event_id") % 20 == 0), folder, 2)
    job = Job(spark, tables, str(folder), tmp_path)
    # the second file is late as a whole unless the delay covers the month
    _, got = job.files(windows.deduplicated(job.patients, delay="40 days"))
    same(got.select("event_id", "event_ts"), tables.patients.select("event_id", "event_ts"))


def test_restart_continues_without_duplicates(spark, tables, tmp_path):
    folder = tmp_path / "restart"
    half = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    put(tables.events.filter(half), folder, 1)
    job = Job(spark, tables, str(folder), tmp_path)
    keys = ["hospital_id", "dept_id", "window_end"]
    job.store(windows.patient_windows(job.patients), keys, "window_end")
    job.files(windows.patient_windows(job.patients))
    put(tables.events.filter(~half), folder, 2)
    put(closing(spark, tables.events.schema), folder, 3)
    job = Job(spark, tables, str(folder), tmp_path)
    want = rounded(flow.flow_features(tables.patients))
    same(rounded(job.store(windows.patient_windows(job.patients), keys, "window_end")[1]), want)
    same(rounded(job.files(windows.patient_windows(job.patients))[1]), want)


def test_fanout_computes_a_batch_once_and_skips_empty_ones(spark, tmp_path):
    hits = spark.sparkContext.accumulator(0)

    def count(rows):
        for pdf in rows:
            hits.add(len(pdf))
            yield pdf

    df = spark.range(100).mapInPandas(count, "id long")
    seen = []
    write = jobs.fanout(lambda b, i: seen.append(b.count()), lambda b, i: b.write.mode("overwrite").parquet(str(tmp_path / "x")))
    write(df, 0)
    write(df.filter("id < 0"), 1)
    assert seen == [100]
    assert hits.value == 200  # once per call, whatever the number of writers

"""Running queries: triggers, fan-out of one micro-batch, drift and alert jobs, health."""

import json
import logging
import threading

from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.storagelevel import StorageLevel

from wardflow import config as C
from wardflow.operators import monitor
from wardflow.session import remove
from wardflow.sources import sinks

log = logging.getLogger(__name__)


def fanout(*writers):
    """A foreachBatch body: the batch is computed once, then given to every writer.

    Writers take (df, batch_id) and replace what an earlier run of the same batch wrote. If an executor
    is lost with its part of the cached batch, Spark computes that part again from the batch's fixed
    source offsets, so a writer never sees a different batch.
    """
    def body(df, batch_id):
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            if not df.isEmpty():
                for write in writers:
                    write(df, batch_id)
        finally:
            df.unpersist()
    return body


def start(df, body, checkpoint, mode="update", name=None, trigger=None):
    """One streaming query with its own checkpoint. Default trigger: the configured interval."""
    writer = df.writeStream.foreachBatch(body).outputMode(mode).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"processingTime": C.FlowConfig.trigger})).start()


def start_files(df, path, checkpoint, trigger=None, name=None):
    """Append-mode query into Spark's own exactly-once file sink."""
    writer = (df.writeStream.format("parquet").option("path", path).outputMode("append")
              .option("checkpointLocation", checkpoint))
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"processingTime": C.FlowConfig.trigger})).start()


def finish(*queries):
    """Wait for bounded queries (availableNow) running side by side."""
    for q in queries:
        q.awaitTermination()
    return queries


def feature_writers(store, topic):
    """The feature job's two sinks: keyed store and feature topic."""
    return fanout(
        lambda df, i: sinks.upsert_batch(df.withColumnRenamed("window_end", "window_ts"), store, i,
                                         "window_ts"),
        lambda df, i: sinks.write_topic(df, topic, i))


def drift_body(spark, state, requests, keys, order, cfg=C.DriftConfig(), on_drift=None):
    """Drift check per micro-batch over the newest records of every series.

    Carries forward only those records (at most `keep_records` per series), one folder per batch,
    so a check never reads the history and a replay starts from the same state; the folders before
    the last one are deleted. `on_drift` is called with the requests of a batch if there are any; what
    it raises is logged and stops nothing.
    """
    def body(df, batch_id):
        if batch_id > 0:
            before = spark.read.parquet(f"{state}/batch={batch_id - 1}")
            df = df.select(*before.columns).unionByName(before)
        monitor.recent(df, keys, order, cfg.keep_records).write.mode("overwrite").parquet(
            f"{state}/batch={batch_id}")
        held = spark.read.parquet(f"{state}/batch={batch_id}")
        report = monitor.drift_status(held, keys, order, cfg)
        found = report.filter(F.col("status") == "drift_detected")
        sinks.append_batch(found, requests, batch_id)
        remove(spark, f"{state}/batch={batch_id - 2}")
        if on_drift is not None:
            rows = spark.read.parquet(f"{requests}/batch_id={batch_id}")
            try:
                if not rows.isEmpty():
                    on_drift(rows, batch_id)
            except Exception:  # a failed retraining must not stop the check of later batches
                log.exception("drift callback failed in batch %s", batch_id)
    return body


def alert_stream(predictions, threshold=C.RED_FROM):
    """Alerts as soon as a forecast crosses the threshold; the actual is not known yet."""
    long = monitor.unpivot_horizons(predictions).withColumn("actual", F.lit(None).cast("double"))
    return sinks.stamp_alerts(monitor.alert_rows(long, threshold))


HEALTH_SCHEMA = ("name string, batch_id long, input_rows long, input_rows_per_second double, "
                 "processed_rows_per_second double, duration_ms long, watermark string, "
                 "state_rows long, late_rows long")


def _report(p):
    """One progress report (a dictionary) as a row."""
    state = p.get("stateOperators") or []
    return (p.get("name"), int(p["batchId"]), int(p.get("numInputRows") or 0),
            float(p.get("inputRowsPerSecond") or 0.0), float(p.get("processedRowsPerSecond") or 0.0),
            int((p.get("durationMs") or {}).get("triggerExecution", 0)), (p.get("eventTime") or {}).get("watermark"),
            sum(int(s.get("numRowsTotal", 0)) for s in state),
            sum(int(s.get("numRowsDroppedByWatermark", 0)) for s in state))


class ProgressLog(StreamingQueryListener):
    """Every progress report of a session's queries, however long they run.

    Reports are kept in memory up to `hold` and then appended to `path`.
    """

    def __init__(self, spark, path, hold=500):
        self.spark, self.path, self.hold = spark, path, hold
        self.rows, self.ended, self.changed, self.written = [], set(), threading.Condition(), False
        spark.streams.addListener(self)

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        with self.changed:
            self.rows.append(_report(json.loads(event.progress.json)))
            if len(self.rows) >= self.hold:
                self._flush()

    def onQueryTerminated(self, event):
        with self.changed:
            self.ended.add(str(event.id))
            self.changed.notify_all()

    def _flush(self):
        if self.rows or not self.written:
            self.spark.createDataFrame(self.rows, HEALTH_SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
            self.rows, self.written = [], True

    def report(self, *queries, wait=60):
        """All reports so far; those of `queries` are complete once they have ended."""
        with self.changed:
            self.changed.wait_for(lambda: {str(q.id) for q in queries} <= self.ended, wait)
            self._flush()
        return self.spark.read.schema(HEALTH_SCHEMA).parquet(self.path)

    def close(self):
        self.spark.streams.removeListener(self)


def health(spark, *queries):
    """The progress reports a query still holds (the last 100 by default); `ProgressLog` has all."""
    rows = [_report(json.loads(p.json) if hasattr(p, "json") and isinstance(p.json, str) else dict(p))
            for q in queries for p in q.recentProgress]
    return spark.createDataFrame(rows, HEALTH_SCHEMA)

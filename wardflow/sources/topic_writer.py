"""A topic of (key, value) rows in files, written by a data source that commits or aborts.

    segments/<name>.parquet   what one task wrote, under a name of its own
    commits/N.json            micro-batch N: the segments that count and their rows

A task only adds a segment and reports it; a batch is visible from the moment its commit is in place, by one rename. An
aborted batch deletes what its tasks reported. A segment of a task that was lost, run twice or still at work when its
batch was aborted is in no commit, so nobody reads it; `sweep` deletes such. A batch that is run again after its commit changes nothing: the first commit stands and the new
segments go. One query writes a topic; any number read it, from any batch on. A stream in append mode writes straight to the
source; Spark offers no update mode for it, so updates are published per micro-batch (`publish_batch`).
"""

import json
import uuid
from dataclasses import dataclass

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from wardflow import config as C
from wardflow.schemas import ENVELOPE
from wardflow.session import remove
from wardflow.sources.codec import encode
from wardflow.sources.store import _names

FORMAT = "flow_topic"


@dataclass
class Segment(WriterCommitMessage):
    name: str
    rows: int


class TopicSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return ENVELOPE

    def streamWriter(self, schema, overwrite):
        return StreamWriter(self.options["path"])

    def writer(self, schema, overwrite):
        return BatchWriter(self.options["path"], int(self.options["batch_id"]))


class Segments:
    """What both writers share: the files of a topic."""

    def __init__(self, path):
        self.path = path

    def _at(self, name):
        fs, at = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)
        at = f"{at}/{name}"
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        return fs, at

    def drop(self, messages):
        for m in messages:
            if m is not None and m.rows:
                fs, at = self._at(f"segments/{m.name}")
                if fs.get_file_info(at).type != pafs.FileType.NotFound:
                    fs.delete_file(at)

    def add(self, iterator):
        """One segment per task; none where the task has no rows."""
        name, rows, out = f"{uuid.uuid4().hex}.parquet", 0, None
        try:
            for batch in iterator:
                if batch.num_rows:
                    if out is None:
                        fs, at = self._at(f"segments/{name}")
                        out = pq.ParquetWriter(at, batch.schema, filesystem=fs, compression="zstd")
                    out.write_batch(batch)
                    rows += batch.num_rows
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(at)
            raise
        return Segment(name, rows)

    def settle(self, messages, batch_id):
        """Puts the batch's commit in place; where it has one, the new segments go."""
        fs, at = self._at(f"commits/{batch_id}.json")
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            self.drop(messages)
            return
        segments = sorted((m.name, m.rows) for m in messages if m is not None and m.rows)
        _, draft = self._at(f"commits/.{batch_id}.draft")
        with fs.open_output_stream(draft, compression=None) as out:
            out.write(json.dumps({"batch_id": batch_id, "segments": [{"name": n, "rows": r} for n, r in segments]}).encode())
        fs.move(draft, at)


class StreamWriter(DataSourceStreamArrowWriter):
    def __init__(self, path):
        self.segments = Segments(path)

    def write(self, iterator):
        return self.segments.add(iterator)

    def commit(self, messages, batchId):
        self.segments.settle(messages, batchId)

    def abort(self, messages, batchId):
        self.segments.drop(messages)


class BatchWriter(DataSourceArrowWriter):
    def __init__(self, path, batch_id):
        self.segments, self.batch_id = Segments(path), batch_id

    def write(self, iterator):
        return self.segments.add(iterator)

    def commit(self, messages):
        self.segments.settle(messages, self.batch_id)

    def abort(self, messages):
        self.segments.drop(messages)


def publish_batch(df, path, batch_id, key="hospital_id"):
    """A sink for `fanout`: one micro-batch as (key, value) to the topic at `path`, whole or not at all."""
    df.sparkSession.dataSource.register(TopicSource)  # each query's micro-batches have a session of their own
    encode(df, key).write.format(FORMAT).mode("append").option("path", path).option("batch_id", str(int(batch_id))).save()


def start_topic(df, path, checkpoint, key="hospital_id", name=None, trigger=None):
    """A streaming query in append mode that publishes its rows as (key, value) to the topic at `path`."""
    # A stream's sink is looked up in the active session, which may be another than the frame's.
    (SparkSession.getActiveSession() or df.sparkSession).dataSource.register(TopicSource)
    writer = (encode(df, key).writeStream.format(FORMAT).option("path", path).outputMode("append")
              .option("checkpointLocation", checkpoint))
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"processingTime": C.FlowConfig.trigger})).start()


def _committed(spark, path, after=-1):
    """Names of the segments of the batches above `after`: one per batch and task that had rows."""
    ids = [n for n in _names(spark, f"{path}/commits") if n.endswith(".json") and int(n[:-5]) > after]
    if not ids:
        return []
    commits = spark.read.schema("batch_id long, segments array<struct<name: string, rows: long>>").json([f"{path}/commits/{n}" for n in ids])
    return [r[0] for r in commits.select(F.explode("segments.name")).collect()]


def read_topic(spark, path, after=-1):
    """(key, value) rows of the committed batches with a number above `after`; none where there is no such batch."""
    segments = _committed(spark, path, after)
    if not segments:
        return spark.createDataFrame([], ENVELOPE)
    return spark.read.schema(ENVELOPE).parquet(*[f"{path}/segments/{n}" for n in segments])


def sweep(spark, path):
    """Deletes the segments of no commit; to be run while no query writes the topic."""
    kept = set(_committed(spark, path))
    for name in _names(spark, f"{path}/segments"):
        if name not in kept:
            remove(spark, f"{path}/segments/{name}")

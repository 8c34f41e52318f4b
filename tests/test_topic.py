"""The topic writer: commits, aborted batches, replays, consumers that go on from a batch."""

import os
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryException

from wardflow.sources import topic_writer

ROWS = "hospital_id string, n long"
NOW = {"availableNow": True}


def feed(spark, path, ids, bad=()):
    spark.createDataFrame([("H1" if i % 2 else None, -1 if i in bad else i) for i in ids], ROWS).repartition(4).write.mode("append").parquet(path)


def publish(spark, tmp_path):
    """Rows with a negative number make their task fail."""
    rows = spark.readStream.schema(ROWS).parquet(str(tmp_path / "in"))
    rows = rows.withColumn("n", F.when(F.col("n") < 0, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("n")))
    topic_writer.start_topic(rows, str(tmp_path / "topic"), str(tmp_path / "ckpt"), trigger=NOW).awaitTermination()


def seen(spark, tmp_path, **kw):
    rows = topic_writer.read_topic(spark, str(tmp_path / "topic"), **kw)
    return sorted(r[0] for r in rows.select(F.get_json_object("value", "$.n").cast("long")).collect())


def segments(tmp_path):
    return sorted(os.listdir(tmp_path / "topic" / "segments"))


def names(tmp_path):
    return [n for n in segments(tmp_path) if not n.startswith(".")]


def test_batches_commit_and_consumers_go_on(spark, tmp_path):
    assert seen(spark, tmp_path) == []
    feed(spark, str(tmp_path / "in"), range(100))
    publish(spark, tmp_path)
    assert seen(spark, tmp_path) == list(range(100))
    feed(spark, str(tmp_path / "in"), range(100, 130))
    publish(spark, tmp_path)
    assert seen(spark, tmp_path) == list(range(130)) and seen(spark, tmp_path, after=0) == list(range(100, 130))
    keys = topic_writer.read_topic(spark, str(tmp_path / "topic")).groupBy("key").count().collect()
    assert {(r.key, r["count"]) for r in keys} == {("H1", 65), (None, 65)}


def test_an_aborted_batch_leaves_nothing(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), range(20))
    publish(spark, tmp_path)
    before = names(tmp_path)
    feed(spark, str(tmp_path / "in"), range(20, 60), bad=(41,))
    with pytest.raises(StreamingQueryException):
        publish(spark, tmp_path)
    assert seen(spark, tmp_path) == list(range(20))
    time.sleep(2)  # a task still at work when the batch was aborted may leave a segment, which no commit names
    topic_writer.sweep(spark, str(tmp_path / "topic"))
    assert seen(spark, tmp_path) == list(range(20)) and names(tmp_path) == before
    assert os.listdir(tmp_path / "topic" / "commits") and not os.path.exists(tmp_path / "topic" / "commits" / "1.json")


def test_a_replayed_batch_is_not_doubled(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), range(50))
    publish(spark, tmp_path)
    before = segments(tmp_path)
    for name in (".0.crc", "0"):  # as if the query had stopped between the sink's commit and its own
        os.replace(tmp_path / "ckpt" / "commits" / name, tmp_path / f"lost{name}")
    publish(spark, tmp_path)
    assert seen(spark, tmp_path) == list(range(50)) and segments(tmp_path) == before


def test_only_committed_segments_count(spark, tmp_path):
    feed(spark, str(tmp_path / "in"), range(10))
    publish(spark, tmp_path)
    one = tmp_path / "topic" / "segments" / segments(tmp_path)[0]
    (tmp_path / "topic" / "segments" / "stray.parquet").write_bytes(one.read_bytes())  # of a task that was lost
    assert seen(spark, tmp_path) == list(range(10))


def test_a_micro_batch_is_published_whole_or_not_at_all(spark, tmp_path):
    topic = str(tmp_path / "topic")
    rows = spark.range(40).repartition(4).selectExpr("'H1' AS hospital_id", "id AS n")
    topic_writer.publish_batch(rows, topic, 7)
    before = segments(tmp_path)
    topic_writer.publish_batch(rows, topic, 7)  # run again
    assert seen(spark, tmp_path) == list(range(40)) and segments(tmp_path) == before
    broken = rows.withColumn("n", F.when(F.col("n") == 21, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("n")))
    with pytest.raises(Exception, match="broken row"):
        topic_writer.publish_batch(broken, topic, 8)
    assert seen(spark, tmp_path) == list(range(40)) and set(before) <= set(segments(tmp_path))
    topic_writer.publish_batch(rows.limit(0), topic, 8)  # an empty batch is a commit without segments
    assert seen(spark, tmp_path, after=7) == [] and sorted(os.listdir(tmp_path / "topic" / "commits")) == ["7.json", "8.json"]

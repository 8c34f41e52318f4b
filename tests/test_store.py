"""Snapshots of the keyed store: pinned readers, merges of touched days only, replays."""

import datetime as dt
import glob
import os

import pytest

from wardflow.sources import store

T0 = dt.datetime(2024, 1, 1, 23, 50)
ROWS = "hospital_id string, dept_id string, window_ts timestamp_ntz, n int"
KEYS = ["hospital_id", "dept_id", "window_ts"]


def put(spark, path, batch, *items):
    rows = spark.createDataFrame([("H1", d, T0 + dt.timedelta(minutes=m), n) for d, m, n in items], ROWS)
    store.write_batch(rows, path, batch)


def seen(snapshot, dates=None):
    return sorted((r.dept_id, r.window_ts.day, r.n) for r in snapshot.read(KEYS, "window_ts", dates).collect())


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/merged/**/*.parquet", recursive=True)}


def test_reader_pinned_while_a_merge_runs(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(ValueError):
        store.Snapshot(spark, path).read(KEYS, "window_ts")
    put(spark, path, 0, ("a", 0, 1), ("a", 10, 1), ("b", 0, 1))
    put(spark, path, 1, ("a", 0, 5), ("c", 20, 7))
    want = [("a", 1, 5), ("a", 2, 1), ("b", 1, 1), ("c", 2, 7)]
    before = store.Snapshot(spark, path)
    reading = before.read(KEYS, "window_ts")
    assert seen(before) == want and before.number == 0
    assert store.merge(spark, path, KEYS, "window_ts") == 1 and store.snapshots(spark, path) == [1]
    old = store.Snapshot(spark, path)
    put(spark, path, 2, ("a", 10, 9))
    first = files(path)
    assert store.merge(spark, path, KEYS, "window_ts") == 2
    assert store.merge(spark, path, KEYS, "window_ts") == 2  # nothing new
    later = [("a", 1, 5), ("a", 2, 9), ("b", 1, 1), ("c", 2, 7)]
    assert seen(store.Snapshot(spark, path)) == later and seen(old) == want and len(reading.collect()) == 4
    assert seen(store.Snapshot(spark, path, 1)) == want
    with pytest.raises(ValueError):
        store.Snapshot(spark, path, 7)
    # the second merge wrote day 2 only; day 1's file is the first merge's, untouched
    second = files(path)
    assert {f: t for f, t in second.items() if f in first} == first
    assert all("dt=2024-01-02" in f for f in second if f not in first) and len(second) > len(first)
    assert seen(store.Snapshot(spark, path), ["2024-01-02"]) == [("a", 2, 9), ("c", 2, 7)]
    store.vacuum(spark, path, keep=1)
    assert seen(store.Snapshot(spark, path)) == later and store.snapshots(spark, path) == [2]
    assert {f.split("/merged/")[1].split("/part")[0] for f in files(path)} == {"id=1/dt=2024-01-01", "id=2/dt=2024-01-02"}
    assert os.listdir(f"{path}/deltas") == []


def test_replays_and_unfinished_writes(spark, tmp_path):
    path = str(tmp_path / "store")
    put(spark, path, 0, ("a", 0, 1))
    put(spark, path, 0, ("a", 0, 1), ("b", 0, 2))  # replayed with more rows
    assert seen(store.Snapshot(spark, path)) == [("a", 1, 1), ("b", 1, 2)]
    put(spark, path, 1, ("a", 0, 3))
    os.remove(f"{path}/deltas/batch_id=1/_SUCCESS")  # the write broke off: not a batch yet
    assert seen(store.Snapshot(spark, path)) == [("a", 1, 1), ("b", 1, 2)]
    # a merge that broke off before its manifest leaves a draft that the next one replaces
    spark.createDataFrame([("H9", "x", T0, 1)], ROWS).write.parquet(f"{path}/merged/id=1/dt=2024-01-01")
    assert seen(store.Snapshot(spark, path)) == [("a", 1, 1), ("b", 1, 2)]
    assert store.merge(spark, path, KEYS, "window_ts") == 1
    assert seen(store.Snapshot(spark, path)) == [("a", 1, 1), ("b", 1, 2)]
    put(spark, path, 0, ("a", 0, 99))  # a replay of a merged batch changes nothing
    assert seen(store.Snapshot(spark, path)) == [("a", 1, 1), ("b", 1, 2)]
    put(spark, path, 1, ("a", 0, 3))
    assert seen(store.Snapshot(spark, path)) == [("a", 1, 3), ("b", 1, 2)]


def test_stream_into_the_store(spark, tables, tmp_path):
    """Micro-batches with a merge after each equal the batch result."""
    from test_scans import same

    from wardflow.operators import flow
    from wardflow.sources import codec
    path = str(tmp_path / "store")
    want = flow.flow_features(tables.patients, "1 hour").withColumnRenamed("window_end", "window_ts")
    parts = want.randomSplit([1.0, 1.0, 1.0], 3)
    for i, part in enumerate([parts[0].withColumn("arrival_count", parts[0].arrival_count + 7), *parts]):
        store.write_batch(part, path, i)
        store.merge(spark, path, KEYS, "window_ts")
    same(codec.without_zone(store.Snapshot(spark, path).read(KEYS, "window_ts")), want)

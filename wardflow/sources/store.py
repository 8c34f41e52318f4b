"""A keyed store of micro-batches with snapshots.

    deltas/batch_id=N/       the rows of micro-batch N, as they came; a replay replaces the folder
    merged/id=K/dt=D/        the current rows of day D as merge K wrote them
    manifests/K.json         snapshot K: which merge holds each day, and the last batch merged

Writing a batch is one append without a shuffle. `merge` folds the batches since the last snapshot into
the days that they touch and leaves all other days' files as they are; the snapshot counts from the moment its
manifest is in place, by one rename. A reader resolves one manifest and one last batch at its start and
keeps reading these, also while later batches and merges are written; `vacuum` removes what the newest
snapshots do not need. Of one key the row of the newest batch is current; `ts` decides the day and must be part of
the key. One writer and one merge at a time.
"""

import json

from pyspark.sql import functions as F

from wardflow.operators.scans import latest_per_key
from wardflow.session import remove


def _files(spark, path):
    """Hadoop's file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark, path):
    fs, at = _files(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def _batches(spark, path):
    """Complete batches: their folder holds the mark of a finished write."""
    ids = [int(n.split("=")[1]) for n in _names(spark, f"{path}/deltas") if n.startswith("batch_id=")]
    return sorted(i for i in ids if "_SUCCESS" in _names(spark, f"{path}/deltas/batch_id={i}"))


def snapshots(spark, path):
    """Numbers of the snapshots in place, ascending."""
    return sorted(int(n[:-5]) for n in _names(spark, f"{path}/manifests") if n.endswith(".json"))


def _manifest(spark, path, number):
    if number == 0:
        return {"id": 0, "upto": -1, "days": {}}
    text = spark.read.text(f"{path}/manifests/{number}.json", wholetext=True).first()[0]
    return json.loads(text)


def _put_manifest(spark, path, manifest):
    """Written under another name first: a name ending in .json is always a whole manifest."""
    fs, draft = _files(spark, f"{path}/manifests/.{manifest['id']}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if not fs.rename(draft, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifests/{manifest['id']}.json")):
        raise RuntimeError(f"snapshot {manifest['id']} of {path} is there already")


def write_batch(df, path, batch_id):
    """Stores a micro-batch; safe to replay until it is merged, after which a replay changes nothing."""
    spark = df.sparkSession
    last = snapshots(spark, path)
    if last and _manifest(spark, path, last[-1])["upto"] >= batch_id:
        return
    df.write.mode("overwrite").parquet(f"{path}/deltas/batch_id={batch_id}")


class Snapshot:
    """What a reader sees: a manifest and the batches complete when it was opened."""

    def __init__(self, spark, path, number=None):
        self.spark, self.path = spark, path
        known = snapshots(spark, path)
        self.number = (known[-1] if known else 0) if number is None else number
        if self.number and self.number not in known:
            raise ValueError(f"no snapshot {self.number} in {path}")
        self.manifest = _manifest(spark, path, self.number)
        self.deltas = [i for i in _batches(spark, path) if i > self.manifest["upto"]] if number is None else []

    def _merged(self, days):
        """The merged rows of the given days, with dt; only these folders are read."""
        paths = [f"{self.path}/merged/id={k}/dt={d}" for d, k in self.manifest["days"].items() if d in days]
        frames = [self.spark.read.parquet(p).withColumns({"dt": F.lit(p.rsplit("=", 1)[1]).cast("date"),
                                                          "batch_id": F.lit(-1).cast("long")}) for p in paths[:1]]
        if len(paths) > 1:  # one read for all: the days are columns of their paths
            frames = [self.spark.read.schema(frames[0].drop("dt", "batch_id").schema).parquet(*paths).withColumns({
                "dt": F.regexp_extract(F.input_file_name(), r"/dt=([0-9-]+)/", 1).cast("date"), "batch_id": F.lit(-1).cast("long")})]
        return frames

    def _new(self, ts):
        paths = [f"{self.path}/deltas/batch_id={i}" for i in self.deltas]
        if not paths:
            return []
        schema = self.spark.read.parquet(paths[0]).schema
        return [self.spark.read.schema(schema).parquet(*paths).withColumns({
            "dt": F.to_date(ts), "batch_id": F.regexp_extract(F.input_file_name(), r"/batch_id=([0-9]+)/", 1).cast("long")})]

    def read(self, keys, ts, dates=None):
        """The current row of every key; `dates` (texts) limits the days, and the merged folders read."""
        days = set(self.manifest["days"]) if dates is None else set(dates)
        new = [f if dates is None else f.filter(F.col("dt").isin(*dates)) for f in self._new(ts)]
        frames = self._merged(days) + new
        if not frames:
            raise ValueError(f"nothing stored in {self.path} for these days")
        out = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
        if not new:  # merged rows are one per key already
            return out.drop("dt", "batch_id")
        return latest_per_key(out, ["dt", *keys], ["batch_id"]).drop("dt", "batch_id")


def merge(spark, path, keys, ts):
    """Folds the batches since the last snapshot into the days they touch; the new snapshot's number, or the
    last one's where there is nothing to fold."""
    seen = Snapshot(spark, path)
    if not seen.deltas:
        return seen.number
    touched = [r[0].isoformat() for r in seen._new(ts)[0].select("dt").distinct().collect() if r[0] is not None]
    number = seen.number + 1
    target = f"{path}/merged/id={number}"
    rows = seen.read(keys, ts, touched).withColumn("dt", F.to_date(ts))
    rows.hint("rebalance", "dt").write.mode("overwrite").partitionBy("dt").parquet(target)  # a draft of a failed merge goes
    _put_manifest(spark, path, {"id": number, "upto": seen.deltas[-1], "days": {**seen.manifest["days"], **dict.fromkeys(touched, number)}})
    return number


def vacuum(spark, path, keep=2):
    """Deletes batches and merged days that none of the newest `keep` snapshots and no open batch needs."""
    known = snapshots(spark, path)
    kept = [_manifest(spark, path, k) for k in known[-keep:]]
    if not kept:
        return
    for i in _batches(spark, path):
        if i <= kept[0]["upto"]:
            remove(spark, f"{path}/deltas/batch_id={i}")
    needed = {(k, d) for m in kept for d, k in m["days"].items()}
    for k in known:
        for name in _names(spark, f"{path}/merged/id={k}"):
            if name.startswith("dt=") and (k, name[3:]) not in needed:
                remove(spark, f"{path}/merged/id={k}/{name}")
    for k in known[:-keep]:
        remove(spark, f"{path}/manifests/{k}.json")

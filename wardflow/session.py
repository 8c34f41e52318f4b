"""Session settings and the shared working folder."""

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# Fixed when the session starts: no Python call sites are recorded while plans are built.
START_ONLY = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

FREE_EXCHANGES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

UNSET_WIDTH = 200  # Spark's default number of shuffle partitions

_own_dir = None


def build_session(app="wardflow", master=None, **conf):
    """A session for jobs and tests. On a cluster the master and the sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **START_ONLY, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tuned(spark):
    """A sibling session (same context and executors) with this library's SQL settings.

    The caller's own session is left as it was.
    """
    twin = spark.newSession()
    for key, value in SETTINGS.items():
        twin.conf.set(key, value)
    # newSession starts from the context's settings: carry over the caller's shuffle width. Where
    # nobody chose one, Spark's 200 would give a stream more state partitions than a small cluster
    # has cores, each with its own commit per batch: twice the cores is enough there.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if width == UNSET_WIDTH:
        width = min(width, 2 * spark.sparkContext.defaultParallelism)
    twin.conf.set("spark.sql.shuffle.partitions", str(width))
    return twin


def staged(df, name):
    """The frame written once to the shared folder and read back.

    For a result that several later steps read: they scan the written table and do not repeat its
    plan, and a lost executor costs a re-read. Contents are window-grain tables, not raw events. The
    exchanges behind it are freed when it is written.
    """
    path, conf = shared_dir(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(FREE_EXCHANGES, None)
    conf.set(FREE_EXCHANGES, "true")  # else they stay on disk until the driver happens to collect its garbage
    try:
        df.write.parquet(path)
    finally:
        conf.unset(FREE_EXCHANGES) if before is None else conf.set(FREE_EXCHANGES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_dir(spark, name):
    """A fresh path in the shared folder named by spark.checkpoint.dir, deleted when Spark ends.

    Only a session on one machine (master local) may go without that setting; it gets a folder of its
    own. On a cluster executors would each write to their own disk, so that is an error.
    """
    global _own_dir
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own_dir is None or not os.path.isdir(_own_dir):
            _own_dir = tempfile.mkdtemp(prefix="wardflow-")
        root = _own_dir
    path = f"{root.rstrip('/')}/wardflow/{name}-{uuid.uuid4().hex[:12]}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def remove(spark, path):
    """Deletes a folder of the shared file system; nothing happens where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)

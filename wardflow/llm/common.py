"""What several operators of this folder share: shipping, shared folders, bytes, components."""

import ctypes
import os
import re
import zipfile
from io import BytesIO

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import functions as F

from wardflow.session import shared_dir, staged  # noqa: F401  (re-used by the operators)


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark):
    """Makes a session ready for these operators: the package is sent to the executors once per Spark
    context, through the shared folder, and Arrow batches get 1,000 rows where the session has Spark's
    default of 10,000, which is made for short rows and not for whole texts."""
    context = spark.sparkContext
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, "1000")
    if getattr(context, "_wardflow_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    path = shared_dir(spark, "code") + "/wardflow.zip"
    save(path, out.getvalue())
    context.addPyFile(path)
    context._wardflow_shipped = True


def tidy(run):
    """A task's function that hands memory back when the task ends: workers live on between tasks."""
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not this C library
                pass
    return inner


def filesystem(uri):
    """(file system, path) of a folder URI as pyarrow knows it: file, hdfs, s3, gs, abfs."""
    if re.match(r"[a-z][a-z0-9+.-]*:", uri):
        uri = re.sub(r"^file:/(?!/)", "file:///", uri)
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def save(uri, data):
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as f:
        f.write(data)


def spread(df, pieces):
    """Rows that are small but each a piece of work, dealt evenly: a task each, four a core at most. The number
    is given to Spark, which would otherwise put so few bytes into one task."""
    return df.repartition(max(1, min(int(pieces or 0), 4 * df.sparkSession.sparkContext.defaultParallelism)))


def free_names(df, *names):
    """The names, each with as many underscores after it as it takes to be none of the columns of `df`."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def held_out(doc_id):
    """Rows no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def slices(batch, column, limit=8 << 20, rows=2048):
    """An Arrow batch cut so that the texts of a slice stay under `limit` bytes (one text at least)."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and (total + n > limit or i - begin >= rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(sizes):
        yield batch.slice(begin)


def components(edges, rounds=60):
    """Connected components of an undirected graph given as columns (a, b): rows (node, root).

    Every node of an edge gets the smallest node it can reach. Each round links every node to the
    smallest neighbour (large star, then small star), so long chains shorten by a factor per round;
    each is written to the shared folder, which cuts the lineage. A hub is never gathered: the minimum
    is a partial aggregate and the joins on it may be split by AQE. Nulls are no nodes.
    """
    spark = edges.sparkSession
    links = staged(edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(rounds):
        # Large star: neighbours above a node are linked to the smallest in its neighbourhood.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        links = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        # Small star: a node and its smaller neighbours are linked to the smallest of them.
        low = links.groupBy("a").agg(F.min("b").alias("m"))
        links = (links.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                                               F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l"))
                 .select("l.*").filter("a <> b").distinct())
        links = staged(links, "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return links.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root").unionByName(
        links.select(F.col("b").alias("node")).distinct().join(links.select("a").distinct(), F.col("node") == F.col("a"), "left_anti")
        .select("node", F.col("node").alias("root")))

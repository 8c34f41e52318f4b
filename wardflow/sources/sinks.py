"""Sinks of micro-batches.

File sinks are safe to replay: every micro-batch writes only into folders named by its batch id, and
replaces them as a whole when the batch is run again. Nothing already stored is rewritten in the hot
path: the keyed upsert is resolved on reading (newest batch wins per key), and `compact` folds the
days it is given. The Kafka sink delivers at least once: a replay sends the batch again.
"""

from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.operators.scans import latest_per_key
from wardflow.sources.codec import encode


def write_topic(df, path, batch_id, key="hospital_id", format="parquet", topic=None, options=None):
    """Publish rows as (key, value). With Kafka the path is unused."""
    rows = encode(df, key)
    if format == "kafka":
        rows.write.format("kafka").option("topic", topic).options(**(options or {})).save()
    else:
        rows.write.mode("overwrite").format(format).save(f"{path}/batch_id={batch_id}")


def append_batch(df, path, batch_id):
    """Append that a replay of the same batch does not double."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def upsert_batch(df, path, batch_id, ts=None):
    """Store rows by batch, and by day where the key holds a time (`ts`)."""
    parts = ["batch_id"]
    if ts is not None:
        # a file per day and about as much data as Spark wants in one, not one per shuffle partition
        df, parts = df.withColumn("dt", F.to_date(ts)).hint("rebalance", "dt"), ["dt", "batch_id"]
    (df.withColumn("batch_id", F.lit(int(batch_id)).cast("long"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(*parts).parquet(path))


def read_latest(spark, path, keys, dates=None):
    """Current row per key: the one of the newest batch. `dates` prunes folders."""
    df = spark.read.parquet(path)
    if dates is not None:
        df = df.filter(F.col("dt").isin(*dates))
    day = ["dt"] if "dt" in df.columns else []
    return latest_per_key(df, [*day, *keys], ["batch_id"]).drop("dt", "batch_id")


def compact(spark, path, target, keys, ts, dates=None):
    """Fold the batches of the given days (default: all) into one per day, in a new folder; readers
    switch when it is complete."""
    upsert_batch(read_latest(spark, path, keys, dates), target, 0, ts)


def archive(df, path, ts):
    """Long-term history, one folder per day."""
    (df.withColumn("dt", F.to_date(ts)).hint("rebalance", "dt")
       .write.mode("overwrite").partitionBy("dt").parquet(path))


def retain(df, ts, as_of, days):
    """Rows younger than the time to live. On a table partitioned by day this also prunes folders."""
    return df.filter(F.col(ts) > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def _flat_predictions(nested):
    version = F.col("model_version") if "model_version" in nested.columns else F.lit(None)
    d = nested.select("hospital_id", "prediction_ts", F.explode("departments").alias("d"),
                      F.coalesce(version, F.lit(C.DEFAULT_VERSION)).alias("model_version"))
    return d.select("hospital_id", "d.dept_id", "prediction_ts", *_horizons("d.forecasts"),
                    "d.max_congestion", "d.severity_label", "model_version")


def prediction_rows(nested):
    """Nested forecasts to one flat row per department."""
    return (_flat_predictions(nested).drop("max_congestion")
            .withColumn("confidence", F.lit(C.DEFAULT_CONFIDENCE)))


def prediction_documents(nested, registry):
    """Search documents: flat rows with department names and the peak."""
    names = registry.select("hospital_id", "dept_id", "dept_name", "dept_type")
    return (_flat_predictions(nested).join(names, ["hospital_id", "dept_id"], "left")
            .withColumnRenamed("prediction_ts", "prediction_timestamp"))


def _horizons(forecasts):
    return [F.coalesce(F.try_element_at(F.col(forecasts), F.lit(label)), F.lit(0.0))
             .alias(f"horizon_{label}") for label in C.HORIZON_LABELS]


def stamp_alerts(alerts):
    return alerts.withColumn("indexed_at", F.current_timestamp())

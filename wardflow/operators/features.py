"""The ten model features."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.functions import scalar as S
from wardflow.operators import census, context, flow, scans


def wait_minutes(events):
    """Minutes from each arrival to the patient's next event of any kind.

    A patient id that holds many rows (a placeholder, for instance) is split by minute.
    """
    moves = events.select("hospital_id", "dept_id", "patient_id", "event_type", "event_ts", "event_id")
    nxt = scans.neighbour(moves, ["hospital_id", "patient_id"], ["event_ts", "event_id"],
                          "event_ts", "event_ts", "next_ts", span="month")
    gap = S.micros("next_ts") - S.micros("event_ts")
    return nxt.filter(F.col("event_type") == "arrival").withColumns({"wait_us": gap, "wait_minutes": gap / F.lit(6e7)})


def avg_wait(events, length="1 hour"):
    return (wait_minutes(events)
            .groupBy("hospital_id", "dept_id", F.window("event_ts", length)["end"].alias("window_end"))
            # whole microseconds are summed, so the order of rows does not matter
            .agg((F.sum("wait_us") / F.count("wait_us") / F.lit(6e7)).alias("avg_wait_time")))


def los_deviation(features, days=7):
    """(mean actual stay - baseline) / baseline, the baseline being the department's mean expected
    stay over the trailing days.

    Works on window rows: sums and counts per window, so the frame never touches single patients.
    """
    trailing = (W.partitionBy("hospital_id", "dept_id").orderBy(S.micros("window_end"))
                .rangeBetween(-days * 86_400_000_000, 0))
    weight = F.when(F.col("avg_expected_los").isNotNull(), F.col("arrival_count")).otherwise(0)
    total = F.coalesce(F.col("avg_expected_los") * F.col("arrival_count"), F.lit(0.0))
    base = features.withColumns({"_w": weight, "_s": total}).withColumn(
        "los_baseline", F.sum("_s").over(trailing) / F.sum("_w").over(trailing))
    return (base.withColumn("los_deviation", (F.col("avg_actual_los") - F.col("los_baseline"))
                            / F.col("los_baseline")).drop("_w", "_s"))


def feature_table(events, signals, registry, length="1 hour", minutes=60, stage=lambda df, name: df):
    """All ten features per department and window, as named columns and as one vector.

    `stage(df, name)` may write a frame that is read twice (see `session.staged`): the window rows
    before the context is attached.
    """
    keys = ["hospital_id", "dept_id", "window_end"]
    rows = los_deviation(flow.flow_features(events, length))
    load = census.occupancy(
        census.census_at_ticks(events.filter(F.col("event_type") == "arrival"), minutes), registry)
    rows = (rows.join(load.select("hospital_id", "dept_id", F.col("tick").alias("window_end"),
                                  "occupancy_ratio"), keys, "left")
            .join(avg_wait(events, length), keys, "left"))
    rows = stage(rows, "window-rows")
    rows = context.attach_context(rows, context.context_windows(signals))
    return (rows.withColumn("feature_vector", S.feature_vector())
            .select(*keys, *C.FEATURES, "feature_vector"))


def feature_stats(features, names=C.FEATURES):
    """Mean and standard deviation of every feature in one pass."""
    return features.agg(*[F.avg(n).alias(f"mean_{n}") for n in names],
                        *[F.stddev_pop(n).alias(f"std_{n}") for n in names])


def node_matrix(features, registry, start, end, step="1 hour"):
    """Dense (hospital, department, step) grid of vectors, zeros where a department is silent."""
    spine = census.dense_spine(registry, start, end, step)
    right = features.select("hospital_id", "dept_id", F.col("window_end").alias("ts"), "feature_vector")
    return (spine.join(right, ["hospital_id", "dept_id", "ts"], "left")
            .withColumn("feature_vector", S.vector_or_zeros("feature_vector")))

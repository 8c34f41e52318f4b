"""Rates, mixes and fits estimated from the event history."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.functions import scalar as S


def arrival_profile(events):
    """Arrivals per active day by hour of day, weekdays and weekends apart.

    Days are counted from day-level partial counts, so no distinct aggregate is needed.
    """
    daily = (events.filter(F.col("event_type") == "arrival")
             .groupBy(F.to_date("event_ts").alias("day"), F.hour("event_ts").alias("hour"))
             .agg(F.count("*").alias("n")))
    return (daily.groupBy("hour", S.weekend("day").alias("weekend"))
            .agg(F.sum("n").alias("n_arrivals"), F.count("*").alias("n_days"))
            .withColumn("arrivals_per_day", F.col("n_arrivals") / F.col("n_days")))


def _typed(events, registry, dept, out):
    kinds = registry.select("hospital_id", F.col("dept_id").alias(dept), F.col("dept_type").alias(out))
    return events.join(kinds, ["hospital_id", dept])


def acuity_mix(events, registry):
    """Share of each acuity among the arrivals of a department type."""
    arrived = (events.filter(F.col("event_type") == "arrival")
               .groupBy("hospital_id", "dept_id", "acuity").agg(F.count("*").alias("n")))
    counts = (_typed(arrived, registry, "dept_id", "dept_type")
              .groupBy("dept_type", "acuity").agg(F.sum("n").alias("n")))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("dept_type")))


def los_lognormal_fit(events):
    log_los = F.log("expected_los_minutes")
    return (events.filter((F.col("event_type") == "arrival") & (F.col("expected_los_minutes") > 0))
            .groupBy("acuity")
            .agg(F.avg(log_los).alias("mu"), F.stddev_samp(log_los).alias("sigma"),
                 F.count("*").alias("n")))


def transition_matrix(events, registry):
    """P(target type given source type) from transfers, counted per department pair first."""
    pairs = (events.filter(F.col("event_type") == "transfer")
             .groupBy("hospital_id", "source_dept_id", "target_dept_id").agg(F.count("*").alias("n")))
    typed = _typed(_typed(pairs, registry, "source_dept_id", "source_type"), registry,
                   "target_dept_id", "target_type")
    counts = typed.groupBy("source_type", "target_type").agg(F.sum("n").alias("n"))
    return counts.withColumn("probability",
                             F.col("n") / F.sum("n").over(W.partitionBy("source_type")))

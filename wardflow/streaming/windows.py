"""Windowed streams. The bodies are the batch operators; only the watermark is added."""

from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.operators import context, flow
from wardflow.sources.codec import with_zone


def watermarked(df, ts="event_ts", delay=C.FlowConfig.watermark):
    return with_zone(df).withWatermark(ts, delay)


def patient_windows(events, cfg=C.FlowConfig(), ts="event_ts"):
    """Flow features per window; update or append mode."""
    return flow.flow_features(watermarked(events, ts, cfg.watermark), cfg.window, cfg.slide, ts)


def context_windows(events, cfg=C.FlowConfig(), ts="event_ts"):
    return context.context_windows(watermarked(events, ts, cfg.context_watermark), cfg.context_window, ts)


def flow_join(events, cfg=C.FlowConfig(), ts="event_ts"):
    """The literal left join of the two aggregates. Spark allows it in append mode only."""
    rows = watermarked(events, ts, cfg.watermark)
    return flow.join_flow(flow.arrivals(rows, cfg.window, cfg.slide, ts),
                          flow.discharges(rows, cfg.window, cfg.slide, ts))


def deduplicated(events, ts="event_ts", delay=C.FlowConfig.watermark, key="event_id"):
    """One row per event id; an id is remembered for as long as its watermark delay."""
    return watermarked(events, ts, delay).dropDuplicatesWithinWatermark([key])


def hourly_rollup(events, cfg=C.FlowConfig(), ts="event_ts", length="1 hour"):
    """10-minute counts per department folded into the model's hourly step (append mode)."""
    here, gone = F.col("event_type") == "arrival", F.col("event_type") == "discharge"
    fine = (watermarked(events, ts, cfg.watermark).filter(here | gone)
            .groupBy(F.window(ts, cfg.window), "hospital_id", "dept_id")
            .agg(F.count_if(here).alias("a"), F.count_if(gone).alias("d")))
    return (fine.groupBy(F.window(F.window_time("window"), length), "hospital_id", "dept_id")
            .agg(F.sum("a").alias("arrival_count"), F.sum("d").alias("discharge_count"))
            .select("hospital_id", "dept_id", F.col("window")["end"].alias("window_end"),
                    "arrival_count", "discharge_count"))


def join_context_interval(events, signals, minutes=30, cfg=C.FlowConfig(), ts="event_ts", spread=8):
    """Each event with its hospital's context of the last full `minutes`; none gives NULLs.

    Readings are first put together per hospital and pane, so an event meets one row at most, however
    many readings there are. A pane is offered under `spread` numbers and an event looks under one of
    them, so a busy hospital is spread over state partitions.
    """
    width = minutes * 60
    left = watermarked(events, ts, cfg.watermark).withColumns({
        "_slot": F.floor(F.unix_seconds(F.col(ts)) / width).cast("long"),
        "_salt": F.pmod(F.xxhash64("event_id"), F.lit(spread)).cast("int")})
    panes = context.signal_panes(watermarked(signals, ts, cfg.context_watermark), f"{minutes} minutes", ts)
    right = panes.select(
        F.col("hospital_id").alias("_hospital"), F.window_time("window").alias("_pane"), F.col("window")["end"].alias("context_ts"),
        *context.SIGNALS, F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("_offer"))
    right = right.withColumn("_next", F.floor(F.unix_seconds("context_ts") / width).cast("long"))
    cond = ((F.col("hospital_id") == F.col("_hospital")) & (F.col("_slot") == F.col("_next")) & (F.col("_salt") == F.col("_offer"))
            & (F.col("_pane") < F.col(ts)) & (F.col("_pane") >= F.col(ts) - F.expr(f"interval {minutes} minutes 1 second")))
    return left.join(right, cond, "left").drop("_slot", "_salt", "_offer", "_hospital", "_pane", "_next")


def enrich(events, registry):
    """Registry columns on every event (stream-static join, rebuilt per micro-batch)."""
    names = registry.select("hospital_id", "dept_id", "dept_name", "dept_type", "capacity")
    return events.join(names, ["hospital_id", "dept_id"], "left")

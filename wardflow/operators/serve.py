"""What the dashboard and the API read."""

from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.functions import scalar as S
from wardflow.operators import census, scans


def hospital_rollup(hospitals, dept_scores):
    """Peak per hospital with its label; 0.0 for a hospital without departments."""
    peak = dept_scores.groupBy("hospital_id").agg(F.max("max_congestion").alias("peak"))
    return (hospitals.join(peak, "hospital_id", "left")
            .withColumn("hospital_max_congestion", F.coalesce("peak", F.lit(0.0)))
            .withColumn("hospital_severity", S.severity_label("hospital_max_congestion")).drop("peak"))


def overview_cards(hospitals, forecasts, registry):
    """Every hospital with its forecast; no forecast shows as green and 0 %."""
    n = registry.groupBy("hospital_id").agg(F.count("*").alias("n_departments"))
    own = forecasts.select("hospital_id", "hospital_max_congestion", "hospital_severity")
    return (hospitals.join(own, "hospital_id", "left").join(n, "hospital_id", "left")
            .select("hospital_id", "hospital_name", "n_departments",
                    F.coalesce("hospital_severity", F.lit("green")).alias("severity"),
                    S.percent("hospital_max_congestion").alias("percent")))


def topology_document(hospitals, registry, edges):
    """Per hospital: its departments and edges, with the transfers seen along each, as sorted arrays
    (bounded by the registry)."""
    d = registry.groupBy("hospital_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "dept_id", "dept_name", "dept_type",
                                             "capacity", "lat", "lon"))).alias("departments"))
    e = edges.groupBy("hospital_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "source_dept", "target_dept", "edge_type",
                                             "base_weight", "transfer_count"))).alias("edges"))
    return (hospitals.join(d, "hospital_id", "left").join(e, "hospital_id", "left")
            .withColumn("total_departments", F.coalesce(F.size("departments"), F.lit(0))))


def forecast_document(hospitals, registry, scores, context, occupancy, horizon="4h", request="all",
                      version=C.DEFAULT_VERSION, trained_at=None):
    """Per hospital: departments with their forecasts, factors, peak and label, and the model's version.

    `scores` holds the newest forecast per department, `context` the newest signals per hospital,
    `occupancy` the newest occupancy per department. `horizon` chooses each department's `forecast`.
    """
    if horizon not in C.HORIZON_LABELS:
        raise ValueError(f"horizon must be one of {', '.join(C.HORIZON_LABELS)}")
    names = registry.select("hospital_id", "dept_id", "dept_name", "dept_type", "ordinal")
    now = occupancy.select("hospital_id", "dept_id", F.col("occupancy_ratio").alias("current_occupancy"))
    rows = (scores.filter(S.wanted_dept("dept_id", F.lit(request)))
            .join(names, ["hospital_id", "dept_id"]).join(now, ["hospital_id", "dept_id"], "left")
            .join(context, "hospital_id", "left"))
    dept = F.struct(
        "ordinal", "dept_id", "dept_name", "dept_type",
        *[S.display_round(f"h{h}", 3).alias(f"h{h}") for h in C.HORIZONS],
        S.display_round(f"h{horizon.removesuffix('h')}", 3).alias("forecast"),
        S.display_round("current_occupancy", 3).alias("current_occupancy"),
        S.display_round("max_congestion", 3).alias("max_congestion"), "severity_label",
        F.struct("weather_score", "flu_index", "traffic_score").alias("contributing_factors"))
    docs = rows.groupBy("hospital_id").agg(F.array_sort(F.collect_list(dept)).alias("departments"),
                                           F.max("ts").alias("prediction_timestamp"))
    docs = docs.withColumn("departments", F.transform("departments", lambda d: d.withField(
        "forecasts", S.forecast_map(*[d[f"h{h}"] for h in C.HORIZONS]))
        .dropFields("ordinal", *[f"h{h}" for h in C.HORIZONS])))
    peak = F.coalesce(F.array_max(F.transform("departments", lambda d: d["max_congestion"])), F.lit(0.0))
    return (hospitals.join(docs, "hospital_id", "left")
            .withColumn("forecast_horizon", F.lit(horizon))
            .withColumn("model_info", F.struct(F.lit(version).alias("version"),
                                               F.lit(trained_at).cast("timestamp_ntz").alias("last_trained")))
            .withColumn("hospital_max_congestion", peak)
            .withColumn("hospital_severity", S.severity_label("hospital_max_congestion")))


def history_range(dense, as_of, hours, hospital_id=None, dept_id=None):
    """The last `hours` steps before `as_of`, oldest first."""
    if not 1 <= hours <= 168:
        raise ValueError("hours must be between 1 and 168")
    end = F.date_trunc("hour", as_of).cast("timestamp_ntz")
    rows = dense.filter((F.col("ts") < end) & (F.col("ts") >= end - F.make_dt_interval(F.lit(0), F.lit(hours))))
    if hospital_id is not None:
        rows = rows.filter(F.col("hospital_id") == hospital_id)
    if dept_id is not None:
        rows = rows.filter(F.col("dept_id") == dept_id)
    return rows.orderBy("ts", "hospital_id", "dept_id")


def history_timeline(dense, value="occupancy_ratio"):
    """One row per hospital and step with a map department -> value."""
    entry = F.struct("dept_id", S.display_round(S.clip_unit(value), 3))
    return dense.groupBy("hospital_id", "ts").agg(
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("departments"))


def peak_department(scores, registry):
    """Department of the highest congestion per hospital; a tie goes to the later one."""
    rows = scores.join(registry.select("hospital_id", "dept_id", "dept_name", "ordinal"),
                       ["hospital_id", "dept_id"])
    top = F.max_by(F.struct("dept_name", "max_congestion"), F.struct("max_congestion", "ordinal"))
    return (rows.groupBy("hospital_id").agg(top.alias("t"))
            .select("hospital_id", F.col("t.dept_name").alias("peak_dept"),
                    S.percent("t.max_congestion").alias("percent")))


def top_departments(scores, k=4):
    order = [F.col("max_congestion").desc(), F.col("dept_id")]
    return scans.top_per_key(scores, ["hospital_id"], order, k).withColumnRenamed("_rn", "rank")


def unknown_hospitals(df, hospitals):
    return df.join(hospitals, "hospital_id", "left_anti")


def restrict_hospitals(df, wanted):
    return df.join(wanted.select("hospital_id").distinct(), "hospital_id", "left_semi")


def dense_occupancy(events, registry, start, end, tick_minutes=60):
    """Occupancy of every department at every hour, 0 where nobody is present."""
    load = census.census_at_ticks(events.filter(F.col("event_type") == "arrival"), tick_minutes)
    spine = census.dense_spine(registry, start, end, f"{tick_minutes} minutes")
    full = census.fill_spine(spine, load.withColumnRenamed("tick", "ts"), ["census"])
    return census.occupancy(full, registry)


def active_model(models, keys=("hospital_id",)):
    """Newest active model per hospital with its metric from the JSON text."""
    live = models.filter("is_active")
    newest = scans.latest_per_key(live, list(keys), ["trained_at", "model_version"])
    return newest.withColumn("metric", F.from_json("metrics_json", "k int")["k"])

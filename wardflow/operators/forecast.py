"""Training sets, forecasts and their evaluation."""

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.functions import scalar as S
from wardflow.operators import graph, monitor, regression, sequences
from wardflow.session import staged

SERIES = ["hospital_id", "dept_id"]


def persistence_forecast(dense, rows=6, value="occupancy_ratio", ts="ts", block=sequences.BLOCK):
    """Baseline: now + recent slope x hours ahead, clamped. `dense` is an hourly grid."""
    def slope(window):
        frame = window.rowsBetween(-(rows - 1), 0)
        fitted = F.when(F.count("*").over(frame) >= 2, F.regr_slope(F.col(value), F.col("_hour")).over(frame))
        return {"slope": F.coalesce(fitted, F.lit(0.0))}

    out = dense.withColumn("_hour", sequences.hours(dense, ts))
    out = sequences.over_blocks(out, slope, rows - 1, 0, SERIES, ts, block)
    return out.withColumns({f"h{h}": S.clip_unit(F.col(value) + F.col("slope") * h)
                            for h in C.HORIZONS}).drop("_hour")


def with_peak(predictions):
    """Peak over the horizons and its label; the label uses the unrounded peak."""
    peak = S.peak_horizon(*[f"h{h}" for h in C.HORIZONS])
    return predictions.withColumns({"max_congestion": S.display_round(peak, 4),
                                    "severity_label": S.severity_label(peak)})


def nested_forecasts(predictions, ts="ts"):
    """One row per hospital and time with an array of departments (bounded by the registry)."""
    scores = [S.display_round(f"h{h}", 4).alias(f"h{h}") for h in C.HORIZONS]
    dept = F.struct("dept_id", *scores, "max_congestion", "severity_label")
    nested = (with_peak(predictions).groupBy("hospital_id", F.col(ts).alias("prediction_ts"))
              .agg(F.array_sort(F.collect_list(dept)).alias("r")))

    def document(d):
        return F.struct(d["dept_id"].alias("dept_id"),
                        S.forecast_map(*[d[f"h{h}"] for h in C.HORIZONS]).alias("forecasts"),
                        d["max_congestion"].alias("max_congestion"),
                        d["severity_label"].alias("severity_label"))

    return nested.select("hospital_id", "prediction_ts", F.transform("r", document).alias("departments"))


def training_set(dense, edges, hospital_ids=None, start=None, end=None, steps=24):
    """(features, sequence, four targets) per department and step.

    `dense` is the hourly node grid with raw vectors. Sequence and targets share one window, so
    they cost one exchange. Features: own z-scored vector, then the in-neighbours' mean.
    """
    rows = dense
    if hospital_ids is not None:
        rows = rows.filter(F.col("hospital_id").isin(*hospital_ids))
    rows = rows.withColumns({"occupancy_ratio": F.col("feature_vector")[0],
                             "feature_vector": S.zscore_vector("feature_vector")})
    rows = graph.neighbour_mean(rows, edges)
    rows = sequences.sequence_and_targets(rows, steps)
    if start is not None:
        rows = rows.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        rows = rows.filter(F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    return rows.withColumn("features", F.concat("feature_vector", "neighbour_vector")).select(
        *SERIES, "ts", "features", "sequence", *[f"target_{h}h" for h in C.HORIZONS])


def split(df, keys=("hospital_id", "dept_id"), ts="ts", parts=10, validation=2):
    """Repeatable 80/20 split by a hash of key and time: a row lands on the same side in every run
    and in every engine that knows md5."""
    text = F.concat_ws("|", *keys, S.micros(ts).cast("string"))
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % parts
    return df.withColumn("is_validation", bucket < validation)


def split_by_time(df, cut, ts="ts"):
    return df.withColumn("is_validation", F.col(ts) >= cut)


def forecast_features(dense, edges, steps=24):
    """What a forecast is made from, for every department and hour with a full history: own z-scored
    vector, in-neighbours' mean, exponentially weighted state and attention over the last `steps` hours.

    No target is needed, so the newest hours are there too.
    """
    rows = dense.withColumns({"occupancy_ratio": F.col("feature_vector")[0], "feature_vector": S.zscore_vector("feature_vector")})
    rows = sequences.sequence(graph.neighbour_mean(rows, edges), steps)
    rows = sequences.history_attention(sequences.temporal_state(rows))
    return rows.select(*SERIES, "ts", "occupancy_ratio",
                       F.concat("feature_vector", "neighbour_vector", "state", "attended").alias("features"))


def time_split(samples, share=0.8, ts="ts"):
    """The last part of the time range validates: no validation hour lies before a training hour."""
    span = samples.agg(F.min(S.micros(ts)).alias("lo"), F.max(S.micros(ts)).alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    return samples.withColumn("is_validation", S.micros(ts) >= lo + (hi - lo) * share)


def train_forecaster(samples, regularization=(0.0, 0.01, 0.1), rounds=4):
    """One linear model per horizon, fitted to the congestion loss; see `regression.fit_asymmetric`.

    Returns ({horizon: model}, metrics rows). `1 + rounds` passes over the samples, which are written to the
    shared folder once, for any number of horizons and regularizations; the driver holds sums and coefficients.
    """
    targets = {f"target_{h}h": h for h in C.HORIZONS}
    data = staged(samples.select("features", "is_validation", *targets), "samples")
    models, found = regression.fit_asymmetric(data, list(targets), regularization, rounds)
    metrics = [(h, float(found[t][0]), float(found[t][1]), float(found[t][2]), int(found[t][3])) for t, h in targets.items()]
    return {h: models[t] for t, h in targets.items()}, metrics


MODEL_SCHEMA = ("model_version string, trained_at timestamp_ntz, is_active boolean, horizon int, intercept double, "
                "coefficients array<double>, metrics_json string")


def save_models(spark, models, metrics, path, version, trained_at):
    """A folder per version: a row per horizon with its coefficients and its metrics as JSON text."""
    by = {m[0]: dict(zip(("horizon", "reg_param", "val_loss", "val_mae", "n_validation"), m)) for m in metrics}
    rows = [(version, trained_at, True, h, float(m.intercept), [float(c) for c in m.coefficients], json.dumps(by[h]))
            for h, m in models.items()]
    spark.createDataFrame(rows, MODEL_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_models(spark, path):
    """The rows of the newest active version."""
    rows = spark.read.schema(MODEL_SCHEMA).option("recursiveFileLookup", "true").parquet(path).filter("is_active")
    newest = rows.groupBy().agg(F.max_by("model_version", F.struct("trained_at", "model_version")).alias("model_version"))
    return rows.join(newest, "model_version")


def _scored(rows, coefficients):
    """Clamped scores h<horizon> of {horizon: (intercept, coefficients)}: a few numbers, applied as columns."""
    for h, (intercept, weights) in coefficients.items():
        weights = F.array(*[F.lit(float(c)) for c in weights])
        dot = F.aggregate(F.zip_with("features", weights, lambda x, w: x * w), F.lit(float(intercept)), lambda a, x: a + x)
        rows = rows.withColumn(f"h{h}", S.clip_unit(dot))
    return rows


def score_saved(rows, models):
    """Forecasts of loaded models, with the version that made them."""
    loaded = models.orderBy("horizon").collect()
    out = _scored(rows, {m["horizon"]: (m["intercept"], m["coefficients"]) for m in loaded})
    return with_peak(out.withColumn("model_version", F.lit(loaded[-1]["model_version"])).drop("features"))


METRICS_SCHEMA = "horizon int, reg_param double, val_loss double, val_mae double, n_validation long"


def score_forecasts(rows, models):
    """All departments of all hospitals in one pass: four clamped scores, peak, label."""
    out = _scored(rows, {h: (m.intercept, m.coefficients) for h, m in models.items()})
    return with_peak(out.select(*SERIES, "ts", *[f"h{h}" for h in models]))


def evaluate_forecasts(pairs, keys=("horizon", "hospital_id", "dept_id")):
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), monitor.mae_column().alias("mae"),
                                    monitor.loss_column().alias("loss"))


def isolate_failures(rows, registry, width=10):
    """Mean z-score of usable vectors; unusable rows keep an error text and do not stop the job."""
    known = registry.select("hospital_id").distinct().withColumn("_known", F.lit(True))
    vec = F.col("feature_vector")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x))
    error = (F.when(F.col("_known").isNull(), "unknown hospital")
             .when(vec.isNull(), "missing features")
             .when(F.size(vec) != width, "wrong width")
             .when(bad, "not a number"))
    usable = F.when(F.col("error").isNull(), F.col("feature_vector"))
    total = F.aggregate(usable, F.lit(0.0), lambda acc, x: acc + x)
    return (rows.join(known, "hospital_id", "left").withColumn("error", error)
            .withColumn("score", total / width).drop("_known"))

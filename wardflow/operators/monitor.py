"""Forecast accuracy, drift and alerts."""

from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.functions import scalar as S
from wardflow.operators import scans

KEYS = ["hospital_id", "dept_id"]


def unpivot_horizons(predictions, prefix="h", horizons=C.HORIZONS):
    """One row per forecast and horizon, with the time it speaks about."""
    options = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"{prefix}{h}").alias("predicted"))
                        for h in horizons])
    rest = [c for c in predictions.columns if c not in {f"{prefix}{h}" for h in horizons}]
    return predictions.select(*rest, F.inline(options))


def join_predictions_actuals(predictions, actuals, value="occupancy_ratio", unit="hour"):
    """A prediction at t for t + h next to the actual of that time step: one equi join."""
    target = (F.date_trunc(unit, "ts").cast("timestamp_ntz")
              + F.make_dt_interval(F.lit(0), F.col("horizon")))
    long = (unpivot_horizons(predictions).filter(F.col("predicted").isNotNull())
            .withColumn("target_ts", target))
    right = actuals.select(*KEYS, F.col("ts").alias("target_ts"), F.col(value).alias("actual"))
    return long.join(right, [*KEYS, "target_ts"])


def _bin_counts(x, name, bins):
    """One conditional count per equal bin of [0, 1]; the last bin is closed."""
    edges = [F.lit(i * (1.0 / bins)) for i in range(bins)] + [F.lit(1.0)]
    out = []
    for i in range(bins):
        upper = (x <= edges[i + 1]) if i == bins - 1 else (x < edges[i + 1])
        out.append(F.count_if((x >= edges[i]) & upper).alias(f"_{name}{i}"))
    return out


def _psi_aggs(predicted, actual, bins):
    p, a = F.col(predicted), F.col(actual)
    return [*_bin_counts(p, "e", bins), *_bin_counts(a, "a", bins),
            F.count(p).alias("_ne"), F.count(a).alias("_na")]


def _fold_bins(counts, keys, cfg, keep=()):
    """The bins as rows, summed per key again: the frame is already partitioned by key, so this
    costs no exchange, and the index comes out as a plain column instead of a huge expression."""
    bins = F.array(*[F.struct(F.col(f"_e{i}").alias("_e"), F.col(f"_a{i}").alias("_a"))
                     for i in range(cfg.bins)])

    def frac(n_bin, n):
        return F.when(F.col(n_bin) == 0, F.lit(cfg.epsilon)).otherwise(
            F.col(n_bin) / (F.col(n) + F.lit(cfg.epsilon)))

    rows = (counts.select(*keys, *keep, "_ne", "_na", F.inline(bins))
            .withColumns({"_fe": frac("_e", "_ne"), "_fa": frac("_a", "_na")}))
    term = (F.col("_fa") - F.col("_fe")) * F.log(F.col("_fa") / F.col("_fe"))
    return rows.groupBy(*keys).agg(F.sum(term).alias("psi"), *[F.max(c).alias(c) for c in keep])


def psi(pairs, keys, predicted="predicted", actual="actual", cfg=C.DriftConfig()):
    """Population stability index per group from one aggregate of conditional counts."""
    return _fold_bins(pairs.groupBy(*keys).agg(*_psi_aggs(predicted, actual, cfg.bins)), keys, cfg)


def mae_column(predicted="predicted", actual="actual"):
    return F.coalesce(F.avg(F.abs(F.col(predicted) - F.col(actual))), F.lit(0.0))


def mae(pairs, keys, predicted="predicted", actual="actual"):
    return pairs.groupBy(*keys).agg(mae_column(predicted, actual).alias("mae"))


def loss_column(predicted="predicted", actual="actual", cfg=C.LossConfig()):
    """Squared error, three times as heavy when high congestion is under-predicted, plus a hinge
    for calls on the wrong side of the threshold."""
    p, y, t = F.col(predicted), F.col(actual), cfg.threshold
    weight = F.when((y > t) & (p < y), cfg.under_penalty).otherwise(1.0)
    hinge = (F.when((y > t) & (p < t - cfg.margin), F.lit(t) - p).otherwise(0.0)
             + F.when((y < t) & (p > t + cfg.margin), F.lit(cfg.false_alarm) * (p - F.lit(t))).otherwise(0.0))
    return F.avg(weight * (p - y) * (p - y)) + cfg.hinge * F.avg(hinge)


def congestion_loss(pairs, keys, predicted="predicted", actual="actual", cfg=C.LossConfig()):
    return pairs.groupBy(*keys).agg(loss_column(predicted, actual, cfg).alias("loss"))


def recent(pairs, keys, order, n=C.DriftConfig.keep_records):
    """The newest `n` records of every series."""
    return scans.top_per_key(pairs, keys, order, n).drop("_rn")


def drift_status(pairs, keys, order, cfg=C.DriftConfig()):
    """Drift report per series over its newest records."""
    last = recent(pairs, keys, order, cfg.keep_records)
    counts = last.groupBy(*keys).agg(F.count("*").alias("records_checked"), mae_column().alias("mae"),
                                     *_psi_aggs("predicted", "actual", cfg.bins))
    rows = _fold_bins(counts, keys, cfg, ["records_checked", "mae"])
    ratio = F.col("mae") / F.lit(max(cfg.baseline_mae, 1e-8))
    few = F.col("records_checked") < cfg.min_records
    drift = (F.col("psi") > cfg.psi_limit) | (ratio > cfg.mae_factor)

    def known(c):
        return F.when(~few, c)

    return rows.select(
        *keys,
        F.when(few, "insufficient_data").when(drift, "drift_detected").otherwise("stable").alias("status"),
        known(S.display_round("psi", 4)).alias("psi"),
        known(S.display_round("mae", 4)).alias("rolling_mae"),
        known(S.display_round(ratio, 2)).alias("mae_ratio"), "records_checked")


def alert_rows(pairs, threshold=C.RED_FROM):
    """One alert per forecast at or above the threshold. Stateless, so it also runs on a stream."""
    return pairs.filter(F.col("predicted") >= threshold).select(
        "hospital_id", "dept_id", F.col("ts").alias("alert_ts"),
        F.concat(F.lit("predicted_"), F.col("horizon").cast("string"), F.lit("h")).alias("alert_type"),
        S.severity_label("predicted").alias("severity"), F.lit(float(threshold)).alias("threshold"),
        F.col("actual").alias("actual_value"), F.col("predicted").alias("predicted_value"),
        F.lit(False).alias("resolved"))


def alert_resolution(alerts, actuals, value="occupancy_ratio"):
    """Resolved time of an alert: the first later actual under its threshold.

    Alerts and calm actuals are stacked and the next calm time is carried back, so no alert is
    paired with every later reading.
    """
    limit = C.RED_FROM
    calm = actuals.filter(F.col(value) < limit).select(
        *KEYS, F.col("ts").alias("alert_ts"), F.col("ts").alias("resolved_ts"), F.lit(0).alias("_side"))
    raised = alerts.drop("resolved").withColumns(
        {"_side": F.lit(1), "resolved_ts": F.lit(None).cast(dict(calm.dtypes)["resolved_ts"])})
    stacked = raised.unionByName(calm, allowMissingColumns=True)
    out = scans.fill(stacked, KEYS, ["alert_ts", "_side"], "alert_ts", ["resolved_ts"], backward=True)
    return (out.filter(F.col("_side") == 1).drop("_side")
            .withColumn("resolved", F.col("resolved_ts").isNotNull()))

"""Linear models of several targets from sums over the rows, also under the asymmetric congestion loss.

Each pass is one partial aggregate: a task adds up its rows' products in matrices of fixed size and sends
them as one row; the driver holds the matrices' sum (a few thousand numbers) and solves it. Targets and penalties
all share a pass, so the number of passes does not depend on theirs.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from wardflow import config as C


@dataclass
class Linear:
    """A fitted model: intercept + coefficients . features."""
    intercept: float
    coefficients: list


def _arrays(batch, targets):
    """(features with a leading 1, targets) of a batch as matrices."""
    width = len(batch.column(0)[0]) if batch.num_rows else 0
    x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
    y = np.column_stack([batch.column(1 + i).to_numpy(zero_copy_only=False) for i in range(targets)])
    return np.column_stack([np.ones(len(x)), x]), y


def _summed(rows, columns, add):
    """The sum over all rows of the matrices that `add(sums, batch)` fills, by name; one row per task, summed by
    position in a partial aggregate."""
    def run(batches):
        sums = {}
        for batch in batches:
            if batch.num_rows:
                add(sums, batch)
        for name, value in sums.items():
            value = np.asarray(value, dtype=np.float64)
            yield pa.RecordBatch.from_pydict({
                "name": [name] * value.size, "at": pa.array(np.arange(value.size), pa.int32()), "value": value.ravel()})

    return rows.select(*columns).mapInArrow(run, "name string, at int, value double").groupBy("name", "at").agg(
        F.sum("value").alias("value"))


def second_moments(rows, targets):
    """i, j, n and the mean product of entries i <= j of (1, features, targets) over the rows."""
    def add(sums, batch):
        z = np.column_stack(_arrays(batch, len(targets)))
        sums["n"] = sums.get("n", 0) + len(z)
        sums[f"products {z.shape[1]}"] = sums.get(f"products {z.shape[1]}", 0) + z.T @ z

    sums = _summed(rows, ["features", *targets], add)
    width = F.substring_index("name", " ", -1).cast("int")
    count = sums.filter("name = 'n'").select("value").scalar()
    return (sums.filter("name LIKE 'products%'")
            .select(F.floor(F.col("at") / width).cast("int").alias("i"), (F.col("at") % width).cast("int").alias("j"), "value")
            .filter("i <= j").withColumn("n", count).select("i", "j", F.col("n").cast("long"), (F.col("value") / F.col("n")).alias("mean")))


def _collected(sums):
    out = {}
    for r in sums.orderBy("name", "at").collect():  # matrices of fixed size, whatever the number of rows
        out.setdefault(r["name"], []).append(r["value"])
    return {k: np.array(v) for k, v in out.items()}


def _solve(a, b, ridge):
    return np.linalg.lstsq(a + np.diag(ridge), b, rcond=None)[0]


def fit_asymmetric(rows, targets, regularization=(0.0,), rounds=4, cfg=C.LossConfig()):
    """One linear model per target, fitted to the congestion loss by reweighted least squares.

    `rows` has `features`, the targets and `is_validation`. The first pass gives the sums of plain least
    squares for every target and penalty. Each further pass evaluates the models so far on the validation rows and
    sums the training rows with the weights and hinge gradients that these models' errors have under the
    loss, which gives the next models. Of all models of a target the one with the lowest validation loss stays, so
    it is never above that of plain least squares. `1 + rounds` passes in all. A penalty p adds p * variance to the
    diagonal, as if features were standardized.

    Returns ({target: Linear}, {target: (penalty, loss, mean absolute error, validation rows)}).
    """
    m = len(targets)
    keep = ["features", *targets, "is_validation"]

    def plain(sums, batch):
        x, y = _arrays(batch, m)
        train = ~batch.column(1 + m).to_numpy(zero_copy_only=False).astype(bool)
        x, y = x[train], y[train]
        for name, value in (("n", len(x)), ("xx", x.T @ x), ("xy", x.T @ y)):
            sums[name] = sums.get(name, 0) + value

    first = _collected(_summed(rows, keep, plain))
    n = first["n"][0] if "n" in first else 0
    if not n:
        return {t: Linear(0.0, []) for t in targets}, {t: (regularization[0], float("inf"), 0.0, 0) for t in targets}
    width = len(first["xy"]) // m
    xx, xy = first["xx"].reshape(width, width) / n, first["xy"].reshape(width, m) / n
    spread = np.maximum(0.0, np.diag(xx) - xx[0] ** 2)
    combos = [(k, reg) for k in range(m) for reg in regularization]
    which = [k for k, _ in combos]
    beta = np.array([_solve(xx, xy[:, k], reg * spread) for k, reg in combos])
    best = {}
    for step in range(rounds):
        def weighted(sums, batch, beta=beta):
            x, y = _arrays(batch, m)
            valid = batch.column(1 + m).to_numpy(zero_copy_only=False).astype(bool)
            y, p = y[:, which], x @ beta.T
            error = np.clip(p[valid], 0.0, 1.0) - y[valid]
            q, z = np.clip(p[valid], 0.0, 1.0), y[valid]
            hinge = (np.where((z > cfg.threshold) & (q < cfg.threshold - cfg.margin), cfg.threshold - q, 0.0)
                     + np.where((z < cfg.threshold) & (q > cfg.threshold + cfg.margin), cfg.false_alarm * (q - cfg.threshold), 0.0))
            loss = np.where((z > cfg.threshold) & (q < z), cfg.under_penalty, 1.0) * error ** 2 + cfg.hinge * hinge
            new = [("valid", valid.sum()), ("loss", loss.sum(axis=0)), ("mae", np.abs(error).sum(axis=0))]
            if step < rounds - 1:
                x, y, p = x[~valid], y[~valid], p[~valid]
                w = np.where((y > cfg.threshold) & (p < y), cfg.under_penalty, 1.0)
                pull = cfg.hinge / 2 * (((y > cfg.threshold) & (p < cfg.threshold - cfg.margin)).astype(float)
                                        - cfg.false_alarm * ((y < cfg.threshold) & (p > cfg.threshold + cfg.margin)))
                new += [("xx", np.stack([(x * w[:, [c]]).T @ x for c in range(len(which))])), ("xy", x.T @ (w * y + pull))]
            for name, value in new:
                sums[name] = sums.get(name, 0) + value

        found = _collected(_summed(rows, keep, weighted))
        seen = found["valid"][0]
        for c, (k, reg) in enumerate(combos):
            loss = found["loss"][c] / seen if seen else float("inf")
            if k not in best or loss < best[k][0]:
                best[k] = (loss, reg, found["mae"][c] / seen if seen else 0.0, int(seen), beta[c])
        if step < rounds - 1:
            xx, xy = found["xx"].reshape(len(combos), width, width) / n, found["xy"].reshape(width, len(combos)) / n
            beta = np.array([_solve(xx[c], xy[:, c], reg * spread) for c, (_, reg) in enumerate(combos)])
    models = {t: Linear(float(best[k][4][0]), best[k][4][1:].tolist()) for k, t in enumerate(targets)}
    return models, {t: (best[k][1], best[k][0], best[k][2], best[k][3]) for k, t in enumerate(targets)}

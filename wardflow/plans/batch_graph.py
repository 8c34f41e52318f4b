"""Registered queries: graph, sequences, training and forecasts."""

import math

from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.operators import forecast, graph, monitor, regression, scans, sequences, serve
from wardflow.plans.batch_flow import unpack
from wardflow.plans.registry import query
from wardflow.session import shared_dir, staged

R10 = range(10)


def cols(prefix, width=10):
    return " ".join(f"{prefix}{i}" for i in range(width))


@query("node_index", """
SELECT hospital_id, dept_id, row_number() OVER (PARTITION BY hospital_id ORDER BY ordinal) - 1 AS node_idx FROM departments
WHERE dept_id IN (SELECT dept_id FROM patient_events)""".replace("row_number() OVER (PARTITION BY hospital_id ORDER BY ordinal) - 1",
       "CAST(row_number() OVER (PARTITION BY hospital_id ORDER BY ordinal) - 1 AS INT)"))
def node_index(t):
    seen = t.registry.join(t.patients.select("dept_id").distinct(), "dept_id", "left_semi")
    return graph.node_index(seen).select("hospital_id", "dept_id", "node_idx")


@query("resolve_edges", """
SELECT x.hospital_id, x.source_dept, x.target_dept, CAST(sum(x.transfer_count) AS BIGINT) AS transfer_count,
 s.ordinal AS source_idx, d.ordinal AS target_idx FROM (
 SELECT hospital_id, source_dept_id AS source_dept, count(*) AS transfer_count,
  CASE WHEN CAST(event_id AS BIGINT) % 100 = 0 THEN concat(hospital_id, '_GHOST') ELSE target_dept_id END AS target_dept
 FROM patient_events WHERE event_type = 'transfer' GROUP BY ALL) x
JOIN departments s ON s.dept_id = x.source_dept JOIN departments d ON d.dept_id = x.target_dept GROUP BY ALL""")
def resolve_edges(t):
    ghost = F.when(F.col("event_id").cast("long") % 100 == 0, F.concat("hospital_id", F.lit("_GHOST")))
    moved = t.patients.withColumn("target_dept_id", F.coalesce(ghost, F.col("target_dept_id")))
    nodes = t.registry.withColumn("node_idx", F.col("ordinal"))
    return graph.resolve_edges(graph.total_transfers(moved), nodes)


_SEEN = "coalesce(c.transfer_count, 0) AS transfer_count"


@query("symmetrize_edges", f"SELECT s.*, {_SEEN} FROM sym_edges s LEFT JOIN transfers c USING (hospital_id, source_dept, target_dept)",
       "base_weight")
def symmetrize_edges(t):
    return graph.with_observed(graph.symmetrize(t.edges), graph.total_transfers(t.patients))


@query("edge_base_weights", f"SELECT b.*, {_SEEN} FROM base_edges b LEFT JOIN transfers c USING (hospital_id, source_dept, target_dept)",
       "base")
def edge_base_weights(t):
    return graph.with_observed(graph.edge_base_weights(t.edges), graph.total_transfers(t.patients))


@query("edge_weights", "SELECT * FROM wedges", "raw weight")
def edge_weights(t):
    return t.weighted_edges


def nodes(t):
    return t.grid.drop("ordinal")


_SRC = ", ".join(f"n.v{i} AS x{i}" for i in R10)


@query("join_neighbors", f"""
SELECT n.hospital_id, e.source_dept, e.target_dept, n.ts, e.weight, {_SRC} FROM grid_1h n
JOIN wedges e ON e.hospital_id = n.hospital_id AND e.source_dept = n.dept_id""", "weight " + cols("x"))
def join_neighbors(t):
    return unpack(graph.join_neighbours(nodes(t), t.weighted_edges), "source_vector", "x")


def _hop(view, src, out):
    mean = ", ".join(f"sum(e.weight * n.{src}{i}) / sum(e.weight) AS m{i}" for i in R10)
    take = ", ".join(f"coalesce(m.m{i}, 0.0) AS {out}{i}" for i in R10)
    return f"""SELECT g.*, {take} FROM {view} g LEFT JOIN (
 SELECT e.hospital_id, e.target_dept AS dept_id, n.ts, {mean} FROM {view} n
 JOIN wedges e ON e.hospital_id = n.hospital_id AND e.source_dept = n.dept_id GROUP BY 1, 2, 3) m
 ON m.hospital_id = g.hospital_id AND m.dept_id = g.dept_id AND m.ts = g.ts"""


@query("neighbor_mean", "SELECT hospital_id, dept_id, ts, " + ", ".join(f"a{i}, b{i}" for i in R10)
       + f" FROM ({_hop('(' + _hop('grid_1h', 'v', 'a') + ')', 'a', 'b')})", cols("a") + " " + cols("b"))
def neighbor_mean(t):
    two = graph.neighbour_hops(nodes(t), t.weighted_edges, ["hop1", "hop2"])
    flat = [F.col(h)[i].alias(f"{p}{i}") for h, p in (("hop1", "a"), ("hop2", "b")) for i in R10]
    return two.select("hospital_id", "dept_id", "ts", *flat)


_LEAK = " + ".join(f"CASE WHEN j.z{i} + i.z{i} + e.weight > 0 THEN j.z{i} + i.z{i} + e.weight "
                   f"ELSE 0.2::DOUBLE * (j.z{i} + i.z{i} + e.weight) END" for i in R10)
_ATT = ", ".join(f"sum(exp(score - peak) * x{i}) / sum(exp(score - peak)) AS g{i}" for i in R10)


@query("graph_attention", f"""
SELECT hospital_id, ts, dept_id, count(*) AS n_edges, {_ATT} FROM (
 SELECT *, max(score) OVER (PARTITION BY hospital_id, ts, dept_id) AS peak FROM (
  SELECT i.hospital_id, i.ts, i.dept_id, {", ".join(f"j.z{i} AS x{i}" for i in R10)}, {_LEAK} AS score
  FROM zgrid_1h i JOIN wedges e ON e.hospital_id = i.hospital_id AND e.target_dept = i.dept_id
  JOIN zgrid_1h j ON j.hospital_id = e.hospital_id AND j.dept_id = e.source_dept AND j.ts = i.ts))
GROUP BY 1, 2, 3""", cols("g"))
def graph_attention(t):
    out = graph.graph_attention(t.zgrid.drop("ordinal"), t.weighted_edges)
    return unpack(out, "attended", "g")


# Two heads of different widths as rows of a parameter table: matrices, edge weights, attention vectors.
HEAD_ROWS = [(0, [[((i + 2 * j) % 5 - 2) / 4 for j in R10] for i in range(3)], [[((3 * i + j) % 7 - 3) / 6 for j in R10] for i in range(3)],
              [0.5, -1.0, 2.0], [0.7, -0.3, 0.4]),
             (1, [[((i + j) % 3 - 1) / 2 for j in R10] for i in range(2)], [[((2 * i + j) % 4 - 1) / 5 for j in R10] for i in range(2)],
              [1.0, 0.25], [-0.6, 0.9])]


def _heads_sql():
    def dot(view, row):
        return "(" + " + ".join(f"{view}.z{i} * {m!r}::DOUBLE" for i, m in enumerate(row)) + ")"

    out, at = [], 0
    for k, left, right, edge, a in HEAD_ROWS:
        pre = [f"({dot('j', left[i])} + {dot('i', right[i])} + e.weight * {edge[i]!r}::DOUBLE)" for i in range(len(left))]
        score = " + ".join(f"CASE WHEN {p} > 0 THEN {p} ELSE 0.2::DOUBLE * {p} END * {w!r}::DOUBLE" for p, w in zip(pre, a))
        xs = ", ".join(f"{dot('j', left[i])} AS x{i}" for i in range(len(left)))
        sums = ", ".join(f"sum(exp(score - peak) * x{i}) / sum(exp(score - peak)) AS g{at + i}" for i in range(len(left)))
        out.append(f"""(SELECT hospital_id, ts, dept_id, count(*) AS n_edges, {sums} FROM (
 SELECT *, max(score) OVER (PARTITION BY hospital_id, ts, dept_id) AS peak FROM (
  SELECT i.hospital_id, i.ts, i.dept_id, {xs}, {score} AS score
  FROM zgrid_1h i JOIN wedges e ON e.hospital_id = i.hospital_id AND e.target_dept = i.dept_id
  JOIN zgrid_1h j ON j.hospital_id = e.hospital_id AND j.dept_id = e.source_dept AND j.ts = i.ts)) GROUP BY 1, 2, 3)""")
        at += len(left)
    return f"SELECT * FROM {out[0]} JOIN {out[1]} USING (hospital_id, ts, dept_id, n_edges)"


@query("graph_attention_heads", _heads_sql(), cols("g", 5))
def graph_attention_heads(t):
    heads = graph.heads_of(t.spark.createDataFrame(HEAD_ROWS, graph.HEADS))
    out = graph.graph_attention(t.zgrid.drop("ordinal"), t.weighted_edges, heads=heads)
    return unpack(out, "attended", "g", 5)


@query("graph_sequence", """
SELECT hospital_id, ts, n_nodes, n_steps, n_edges, load FROM (
 SELECT hospital_id, ts, count(*) AS n_nodes, CAST(max(k) AS BIGINT) AS n_steps, sum(s) AS load FROM (
  SELECT hospital_id, dept_id, ts, count(*) OVER w AS k, sum(v0) OVER w AS s FROM grid_1h
  WINDOW w AS (PARTITION BY hospital_id, dept_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)) WHERE k = 24 GROUP BY 1, 2)
JOIN (SELECT hospital_id, count(*) AS n_edges FROM wedges GROUP BY 1) USING (hospital_id)""", "load")
def graph_sequence(t):
    seq = graph.graph_sequence(sequences.sequence(t.grid), t.weighted_edges)
    occupied = F.aggregate(F.flatten(F.transform("nodes", lambda n: n["sequence"])), F.lit(0.0),
                           lambda acc, v: acc + v[0])
    return seq.select("hospital_id", "ts", F.size("nodes").cast("long").alias("n_nodes"),
                      F.size(F.col("nodes")[0]["sequence"]).cast("long").alias("n_steps"),
                      F.size("edges").cast("long").alias("n_edges"), occupied.alias("load"))


_STEPS24 = "JOIN {0} b ON b.hospital_id = a.hospital_id AND b.dept_id = a.dept_id AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL 24 HOURS"
_FULL = "WHERE a.ts >= (SELECT lo + INTERVAL 23 HOURS FROM span)"


@query("sequence_24", f"""
SELECT a.hospital_id, a.dept_id, a.ts, count(*) AS steps, arg_min(b.v1, b.ts) AS oldest, arg_max(b.v1, b.ts) AS newest,
 sum(b.v1) AS total FROM grid_1h a {_STEPS24.format('grid_1h')} {_FULL} GROUP BY 1, 2, 3""", "oldest newest total")
def sequence_24(t):
    seq = sequences.sequence(t.grid)
    s = F.col("sequence")
    return seq.select("hospital_id", "dept_id", "ts", F.size(s).cast("long").alias("steps"),
                      s[0][1].alias("oldest"), F.element_at(s, -1)[1].alias("newest"),
                      F.aggregate(s, F.lit(0.0), lambda acc, v: acc + v[1]).alias("total"))


_TARGETS = "target_1h target_2h target_4h target_8h"


@query("horizon_targets", """
SELECT a.hospital_id, a.dept_id, a.ts, a.occupancy_ratio, b1.occupancy_ratio AS target_1h, b2.occupancy_ratio AS target_2h,
 b4.occupancy_ratio AS target_4h, b8.occupancy_ratio AS target_8h FROM occ_1h a """ + " ".join(
    f"JOIN occ_1h b{h} ON b{h}.dept_id = a.dept_id AND b{h}.ts = a.ts + INTERVAL {h} HOURS" for h in C.HORIZONS),
       "occupancy_ratio " + _TARGETS)
def horizon_targets(t):
    out = sequences.horizon_targets(t.occupancy)
    return out.select("hospital_id", "dept_id", "ts", "occupancy_ratio", *_TARGETS.split())


_DOT = " + ".join(f"a.z{i} * b.z{i}" for i in R10)
_HATT = ", ".join(f"sum(exp(score - peak) * x{i}) / sum(exp(score - peak)) AS h{i}" for i in R10)


@query("history_attention", f"""
SELECT hospital_id, dept_id, ts, {_HATT} FROM (SELECT *, max(score) OVER (PARTITION BY dept_id, ts) AS peak FROM (
 SELECT a.hospital_id, a.dept_id, a.ts, {", ".join(f"b.z{i} AS x{i}" for i in R10)}, ({_DOT}) / {math.sqrt(10)!r} AS score
 FROM zgrid_1h a {_STEPS24.format('zgrid_1h')} {_FULL})) GROUP BY 1, 2, 3""", cols("h"))
def history_attention(t):
    out = sequences.history_attention(sequences.sequence(t.zgrid))
    return unpack(out.select("hospital_id", "dept_id", "ts", "attended"), "attended", "h")


_EW = ", ".join(f"list_reduce(list(b.v{i} ORDER BY b.ts), lambda s, x: x * 0.3::DOUBLE + s * 0.7::DOUBLE) AS s{i}" for i in R10)


@query("temporal_state", f"""
SELECT a.hospital_id, a.dept_id, a.ts, {_EW} FROM grid_1h a {_STEPS24.format('grid_1h')} {_FULL} GROUP BY 1, 2, 3""", cols("s"))
def temporal_state(t):
    out = sequences.temporal_state(sequences.sequence(t.grid))
    return unpack(out.select("hospital_id", "dept_id", "ts", "state"), "state", "s")


def samples(t):
    return forecast.training_set(t.grid.drop("ordinal"), t.weighted_edges)


_OWN = ", ".join(f"g.z{i} AS f{i}" for i in R10) + ", " + ", ".join(f"g.nb{i} AS f{i + 10}" for i in R10)


@query("training_set", f"""
SELECT g.hospital_id, g.dept_id, g.ts, {_OWN}, b1.v0 AS target_1h, b2.v0 AS target_2h, b4.v0 AS target_4h, b8.v0 AS target_8h
FROM ({_hop('zgrid_1h', 'z', 'nb')}) g """ + " ".join(
    f"JOIN grid_1h b{h} ON b{h}.dept_id = g.dept_id AND b{h}.ts = g.ts + INTERVAL {h} HOURS" for h in C.HORIZONS)
    + " WHERE g.hospital_id IN ('H1', 'H3') AND g.ts >= greatest(TIMESTAMP '2024-01-03', (SELECT lo + INTERVAL 23 HOURS FROM span)) AND g.ts < TIMESTAMP '2024-01-27'",
       cols("f", 20) + " " + _TARGETS)
def training_set(t):
    out = forecast.training_set(t.grid.drop("ordinal"), t.weighted_edges, ["H1", "H3", "H77"],
                                "2024-01-03", "2024-01-27")
    return unpack(out.drop("sequence"), "features", "f", 20)


_ENTRY = "list_concat([1.0::DOUBLE], [" + ", ".join([f"f{i}" for i in range(20)] + _TARGETS.split()) + "])"


@query("normal_equations", f"""
SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, count(*) AS n, avg(z[i + 1] * z[j + 1]) AS mean FROM (
 SELECT {_ENTRY} AS z FROM (SELECT {_OWN}, b1.v0 AS target_1h, b2.v0 AS target_2h, b4.v0 AS target_4h, b8.v0 AS target_8h
  FROM ({_hop('zgrid_1h', 'z', 'nb')}) g """ + " ".join(
    f"JOIN grid_1h b{h} ON b{h}.dept_id = g.dept_id AND b{h}.ts = g.ts + INTERVAL {h} HOURS" for h in C.HORIZONS)
    + " WHERE g.ts >= (SELECT lo + INTERVAL 23 HOURS FROM span))) CROSS JOIN range(25) a(i) JOIN range(25) b(j) ON i <= j GROUP BY 1, 2", "mean")
def normal_equations(t):
    """What the forecaster is solved from: mean products of (1, features, targets)."""
    return regression.second_moments(samples(t), _TARGETS.split())


@query("split_80_20", """
SELECT hospital_id, is_validation, count(*) AS n FROM (SELECT hospital_id, CAST('0x' || substr(md5(concat_ws('|', hospital_id, dept_id,
 CAST(epoch_us(ts) AS string))), 1, 8) AS BIGINT) % 10 < 2 AS is_validation FROM spine_1h) GROUP BY 1, 2""")
def split_80_20(t):
    out = forecast.split(t.occupancy.select("hospital_id", "dept_id", "ts"))
    return out.groupBy("hospital_id", "is_validation").agg(F.count("*").alias("n"))


def _trained(t, regularization):
    """Features of every hour, and the folder of the models learned from those whose targets are known."""
    rows = staged(forecast.forecast_features(t.grid.drop("ordinal"), t.weighted_edges), "forecast-features")
    known = forecast.time_split(sequences.horizon_targets(rows))
    models, metrics = forecast.train_forecaster(known, regularization)
    path = shared_dir(t.spark, "models")
    newest = rows.agg(F.max("ts").alias("ts")).first()["ts"]
    forecast.save_models(t.spark, models, metrics, path, "v1", newest)
    return rows, path


@query("train_forecaster")
def train_forecaster(t):
    _, path = _trained(t, (0.0, 0.1))
    saved = forecast.load_models(t.spark, path)
    return saved.select("model_version", F.from_json("metrics_json", forecast.METRICS_SCHEMA).alias("m")).select("model_version", "m.*")


@query("score_forecasts")
def score_forecasts(t):
    """The newest hour of every department, by the models saved and loaded again."""
    rows, path = _trained(t, (0.0,))
    newest = scans.latest_per_key(rows.select("hospital_id", "dept_id", "ts", "features"), ["hospital_id", "dept_id"], ["ts"])
    return forecast.score_saved(newest, forecast.load_models(t.spark, path))


_SLOPE = "coalesce(CASE WHEN count(*) OVER w >= 2 THEN regr_slope(occupancy_ratio, epoch_us(ts) / 3.6e9) OVER w END, 0.0)"


@query("persistence_forecast", "SELECT hospital_id, dept_id, ts, occupancy_ratio, slope, " + ", ".join(
    f"greatest(0.0, least(1.0, occupancy_ratio + slope * {h})) AS h{h}" for h in C.HORIZONS) + f""" FROM (
 SELECT *, {_SLOPE} AS slope FROM occ_1h WINDOW w AS (PARTITION BY hospital_id, dept_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))""",
       "occupancy_ratio slope h1 h2 h4 h8")
def persistence_forecast(t):
    return forecast.persistence_forecast(t.occupancy).select(
        "hospital_id", "dept_id", "ts", "occupancy_ratio", "slope", *[f"h{h}" for h in C.HORIZONS])


def pairs(t):
    return monitor.join_predictions_actuals(t.raw_forecasts, t.occupancy)


def _eval_sql():
    from wardflow.plans.views import LOSS
    return f"""SELECT horizon, hospital_id, dept_id, count(*) AS n, avg(abs(predicted - actual)) AS mae, {LOSS} AS loss
FROM pairs GROUP BY 1, 2, 3"""


@query("evaluate_forecasts", _eval_sql(), "mae loss")
def evaluate_forecasts(t):
    return forecast.evaluate_forecasts(pairs(t))


@query("isolate_failures", """
SELECT event_id, hospital_id, error, CASE WHEN error IS NULL THEN x * 10 / 10 END AS score FROM (
 SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'H9' ELSE concat('H', CAST(user_id % 6 + 1 AS string)) END AS hospital_id, value AS x,
 CASE WHEN event_id % 13 = 0 THEN 'unknown hospital' WHEN event_id % 7 = 0 THEN 'missing features'
  WHEN event_id % 5 = 0 THEN 'wrong width' WHEN event_id % 11 = 0 THEN 'not a number' END AS error FROM events)""", "score")
def isolate_failures(t):
    e, v = F.col("event_id"), F.col("value")
    x = F.when(e % 11 == 0, F.lit(float("nan"))).otherwise(v)
    vec = (F.when(e % 7 == 0, F.lit(None)).when(e % 5 == 0, F.array(v, v, v))
           .otherwise(F.array_repeat(x, 10)))
    hospital = F.when(e % 13 == 0, "H9").otherwise(F.concat(F.lit("H"), (F.col("user_id") % 6 + 1).cast("string")))
    rows = t.events.select("event_id", hospital.alias("hospital_id"), vec.alias("feature_vector"))
    return forecast.isolate_failures(rows, t.registry).drop("feature_vector")

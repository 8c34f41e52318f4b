"""Department graph: edges, weights, neighbour features, attention."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.functions import scalar as S
from wardflow.operators import sequences

# Factor per edge type; two-way types; blend of static and observed weight.
TYPE_FACTOR = {"TRANSFER": 1.0, "SHARED_RESOURCE": 0.8, "PROXIMITY": 0.4}
OTHER_FACTOR = 0.5
TWO_WAY = ("SHARED_RESOURCE", "PROXIMITY")
UNKNOWN_BASE = 0.3
STATIC_SHARE, DYNAMIC_SHARE = 0.6, 0.4
PAIR = ["hospital_id", "source_dept", "target_dept"]


def node_index(registry):
    """0-based index of a department in its hospital, by registry order."""
    order = W.partitionBy("hospital_id").orderBy("ordinal")
    return registry.withColumn("node_idx", F.row_number().over(order) - 1)


def symmetrize(edges):
    """Adds the reversed copy of two-way edges. Parallel edges stay."""
    back = edges.filter(F.col("edge_type").isin(*TWO_WAY)).withColumns(
        {"source_dept": F.col("target_dept"), "target_dept": F.col("source_dept")})
    return (edges.withColumn("reversed", F.lit(False))
            .unionByName(back.withColumn("reversed", F.lit(True))))


def resolve_edges(edges, nodes):
    """Endpoints as node indexes; edges with an unknown end are dropped."""
    def side(name):
        return nodes.select("hospital_id", F.col("dept_id").alias(f"{name}_dept"),
                            F.col("node_idx").alias(f"{name}_idx"))

    return (edges.join(side("source"), ["hospital_id", "source_dept"])
            .join(side("target"), ["hospital_id", "target_dept"]))


def transfer_counts(events, length_minutes=24 * 60, slide_minutes=10):
    """Transfers per pair in a sliding window.

    `window(ts, 24 h, 10 min)` would copy every event 144 times before the aggregate. Here events are first
    counted per slide ("pane"). A pane's count enters the windows at one end and leaves them at another, so a
    pair's sum changes at two ends per pane only; between them it is constant and is unfolded at the last, after
    the exchange. A sum looks one length back, so a pair is dealt in blocks of time, with copied edges. The
    length must be a multiple of the slide.
    """
    if length_minutes % slide_minutes:
        raise ValueError("the window length must be a multiple of the slide")
    step, panes = slide_minutes * 60_000_000, length_minutes // slide_minutes
    pane = F.floor(S.micros("event_ts") / F.lit(step)).cast("long")
    counts = (events.filter(F.col("event_type") == "transfer")
              .groupBy("hospital_id", F.col("source_dept_id").alias("source_dept"),
                       F.col("target_dept_id").alias("target_dept"), pane.alias("pane"))
              .agg(F.count("*").alias("n")))
    changes = counts.select(*PAIR, F.inline(F.array(
        F.struct((F.col("pane") + 1).alias("end"), F.col("n")),
        F.struct((F.col("pane") + 1 + panes).alias("end"), F.lit(0).cast("long").alias("n")))))
    runs = sequences.over_blocks(changes, lambda w: {
        "transfer_count": F.sum("n").over(w.rangeBetween(-(panes - 1), 0)),
        "_enters": F.max("n").over(w.rangeBetween(0, 0)),
        "_next": F.min("end").over(w.rangeBetween(1, panes))}, panes, panes, PAIR, "end", 14 * panes)
    # Where one pane enters and another leaves at the same end, one row stands for both.
    runs = runs.filter((F.col("transfer_count") > 0) & ((F.col("n") > 0) | (F.col("_enters") == 0)))
    return (runs.withColumn("end", F.explode(F.sequence(F.col("end"), F.col("_next") - 1)))
            .select(*PAIR, S.from_micros(F.col("end") * step).alias("window_end"), "transfer_count"))


def total_transfers(events):
    return (events.filter(F.col("event_type") == "transfer")
            .groupBy("hospital_id", F.col("source_dept_id").alias("source_dept"),
                     F.col("target_dept_id").alias("target_dept"))
            .agg(F.count("*").alias("transfer_count")))


def with_observed(edges, counts):
    """Directed edges with the transfers seen along them; 0 where there were none."""
    return (edges.join(counts.select(*PAIR, "transfer_count"), PAIR, "left")
            .withColumn("transfer_count", F.coalesce("transfer_count", F.lit(0))))


def edge_base_weights(edges):
    """One static weight per directed pair; where edges overlap, the last definition wins."""
    factor = F.lit(OTHER_FACTOR)
    for kind, value in TYPE_FACTOR.items():
        factor = F.when(F.col("edge_type") == kind, value).otherwise(factor)
    weighted = symmetrize(edges).withColumn("w", F.col("base_weight") * factor)
    return weighted.groupBy(*PAIR).agg(F.max_by("w", "ordinal").alias("base"))


def edge_weights(edges, counts=None):
    """Weights of all directed edges; those leaving a department sum to 1."""
    rows = symmetrize(edges).join(edge_base_weights(edges), PAIR, "left")
    static = F.coalesce("base", F.lit(UNKNOWN_BASE))
    if counts is None:
        rows = rows.withColumn("raw", static)
    else:
        counts = counts.select(*PAIR, "transfer_count")
        peak = counts.groupBy("hospital_id").agg(F.max("transfer_count").alias("peak"))
        share = (F.coalesce(F.col("transfer_count"), F.lit(0))
                 / F.greatest(F.coalesce("peak", F.lit(1)), F.lit(1)))
        rows = (rows.join(counts, PAIR, "left").join(peak, "hospital_id", "left")
                .withColumn("raw", STATIC_SHARE * static + DYNAMIC_SHARE * share))
    out = W.partitionBy("hospital_id", "source_dept")
    norm = F.col("raw") / F.greatest(F.sum("raw").over(out), F.lit(1e-8))
    return rows.withColumn("weight", norm).select(
        *PAIR, "edge_type", "ordinal", "reversed", "raw", "weight")


def join_neighbours(nodes, edges, vector="feature_vector"):
    """For each department and step, one row per in-edge with the vector of its source."""
    src = nodes.select("hospital_id", F.col("dept_id").alias("source_dept"), "ts",
                       F.col(vector).alias("source_vector"))
    return src.join(edges.select(*PAIR, "weight"), ["hospital_id", "source_dept"])


def _grid_blocks(nodes, edges):
    """One row per hospital and step with its departments' rows and its weighted edges.

    Both arrays are bounded by the hospital's departments and edges; this is the only exchange of the grid,
    whatever is then computed along the edges.
    """
    rest = [c for c in nodes.columns if c not in ("hospital_id", "ts")]
    grid = nodes.groupBy("hospital_id", "ts").agg(F.collect_list(F.struct(*rest)).alias("nodes"))
    links = edges.groupBy("hospital_id").agg(
        F.sort_array(F.collect_list(F.struct("source_dept", "target_dept", "weight"))).alias("links"))
    return grid.join(links, "hospital_id", "left").withColumn("links", F.coalesce("links", F.array()))


def _pulled(dept, values):
    """Per edge into `dept`: its weight `w` and, as `x`, the `values` of the row at its source."""
    into = F.filter("links", lambda e: e["target_dept"] == dept)
    return F.flatten(F.transform(into, lambda e: F.transform(
        F.filter("nodes", lambda m: m["dept_id"] == e["source_dept"]),
        lambda m: F.struct(e["weight"].alias("w"), m[values].alias("x")))))


def _weighted_sum(pairs, width):
    """Per position the sum of w * x, after the sum of w itself."""
    return F.aggregate(pairs, F.array_repeat(F.lit(0.0), width + 1), lambda acc, p: F.zip_with(
        acc, F.concat(F.array(F.lit(1.0)), p["x"]), lambda s, x: s + p["w"] * x))


def neighbour_hops(nodes, edges, outs, vector="feature_vector", width=10):
    """Weighted mean of the in-neighbours' vectors, then the mean of these means and so on, one column of
    `outs` per hop; zeros without in-edges. All hops share one exchange of the grid."""
    out = _grid_blocks(nodes, edges)
    for name, source in zip(outs, [vector, *outs]):
        def mean(n, source=source):
            total = _weighted_sum(_pulled(n["dept_id"], source), width)
            return F.transform(F.array(total), lambda t: F.when(
                t[0] > 0, F.transform(F.slice(t, 2, width), lambda x: x / t[0])).otherwise(F.array_repeat(F.lit(0.0), width)))[0]
        out = out.withColumn("nodes", F.transform("nodes", lambda n: n.withField(name, mean(n))))
    # The outer form: for `inline` the optimizer adds a filter on the array's size, which computes the array again.
    return out.select("hospital_id", "ts", F.inline_outer("nodes")).select(*nodes.columns, *outs)


def neighbour_mean(nodes, edges, vector="feature_vector", out="neighbour_vector", width=10):
    """Weighted mean of the in-neighbours' vectors; zeros without in-edges."""
    return neighbour_hops(nodes, edges, [out], vector, width)


HEADS = "head int, w_left array<array<double>>, w_right array<array<double>>, w_edge array<double>, a array<double>"


def heads_of(table):
    """The heads of a parameter table with the columns of HEADS, in order of `head`: a few rows."""
    return [{c: r[c] for c in ("w_left", "w_right", "w_edge", "a")} for r in table.orderBy("head").collect()]


def _times(matrix, vec):
    """Matrix times vector; None is the identity."""
    if matrix is None:
        return vec
    rows = F.array(*[F.array(*[F.lit(float(m)) for m in row]) for row in matrix])
    return F.transform(rows, lambda row: F.aggregate(F.zip_with(row, vec, lambda m, x: m * x), F.lit(0.0), lambda s, x: s + x))


def graph_attention(nodes, edges, w_left=None, w_right=None, w_edge=None, a=None, slope=0.2,
                    vector="feature_vector", width=10, heads=None, concat=True):
    """Attention over in-edges: score = a . leaky_relu(Wl x_j + Wr x_i + We w_ij), softmax per department
    and step, weighted sum of Wl x_j. Matrices are plain parameters (None: identity).

    `heads` takes several sets of parameters (see `heads_of`); their results are concatenated, or
    averaged (`concat=False`). All heads share one exchange of the grid.
    """
    heads = heads or [{"w_left": w_left, "w_right": w_right, "w_edge": w_edge, "a": a}]
    widths = [len(h["w_left"]) if h["w_left"] else width for h in heads]
    out = _grid_blocks(nodes.select("hospital_id", "ts", "dept_id", F.col(vector).alias("_x")), edges)
    out = out.withColumn("nodes", F.transform("nodes", lambda n: F.struct(
        n["dept_id"].alias("dept_id"),
        *[_times(h["w_left"], n["_x"]).alias(f"l{k}") for k, h in enumerate(heads)],
        *[_times(h["w_right"], n["_x"]).alias(f"r{k}") for k, h in enumerate(heads)])))

    def attended(n, k, h):
        on = [F.array(*[F.lit(float(v)) for v in (h[name] or [1.0] * widths[k])]) for name in ("w_edge", "a")]

        def score(p):
            pre = F.zip_with(F.zip_with(p["x"], n[f"r{k}"], lambda left, right: left + right), on[0], lambda s, e: s + e * p["w"])
            return F.aggregate(F.zip_with(pre, on[1], lambda s, w: F.when(s > 0, s).otherwise(s * slope) * w),
                               F.lit(0.0), lambda s, x: s + x)

        def softmax(pairs):
            scores = F.transform(pairs, score)
            weights = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))[0]
            total = _weighted_sum(F.zip_with(pairs, weights, lambda p, w: F.struct(w.alias("w"), p["x"].alias("x"))), widths[k])
            return F.transform(F.array(total), lambda t: F.when(
                t[0] > 0, F.transform(F.slice(t, 2, widths[k]), lambda x: x / t[0])))[0]

        return F.transform(F.array(_pulled(n["dept_id"], f"l{k}")), softmax)[0]

    def joined(n):
        parts = [attended(n, k, h) for k, h in enumerate(heads)]
        if concat or len(parts) == 1:
            return F.concat(*parts)
        return F.transform(F.arrays_zip(*[p.alias(f"p{k}") for k, p in enumerate(parts)]),
                           lambda z: S.add_all([z[f"p{k}"] for k in range(len(parts))]) / len(parts))

    into = out.select("hospital_id", "ts", F.inline_outer(F.transform("nodes", lambda n: F.struct(
        n["dept_id"].alias("dept_id"), F.size(_pulled(n["dept_id"], "l0")).cast("long").alias("n_edges"), joined(n).alias("attended")))))
    return into.filter("n_edges > 0").select("hospital_id", "ts", "dept_id", "n_edges", "attended")


def graph_sequence(sequences, edges):
    """Per hospital and step: the departments' vector sequences and the weighted edges.

    Both lists are bounded by the hospital's departments and edges.
    """
    snaps = sequences.groupBy("hospital_id", "ts").agg(
        F.array_sort(F.collect_list(F.struct("dept_id", "sequence"))).alias("nodes"))
    links = edges.groupBy("hospital_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "reversed", "source_dept", "target_dept", "weight")))
        .alias("edges"))
    return snaps.join(links, "hospital_id")

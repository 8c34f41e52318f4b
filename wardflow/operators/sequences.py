"""Fixed-length sequences per department and what is computed on them."""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from wardflow.functions import scalar as S

SERIES = ("hospital_id", "dept_id")
BLOCK = 24 * 14  # hours of a series in one task's window


def hours(df, ts):
    """The time as a number of hours (or the column itself, where it is a number already)."""
    return F.col(ts) if isinstance(df.schema[ts].dataType, NumericType) else S.micros(ts) / F.lit(3.6e9)


def over_blocks(df, columns, back=0, ahead=0, keys=SERIES, ts="ts", block=BLOCK):
    """Adds `columns(window)`, a map of window columns that look at most `back` hours back and `ahead` ahead.

    A window by series would put all its years into one task. Here a series is cut into blocks of time and each
    block gets copies of the rows of its neighbours that its own rows look at; the copies are dropped afterwards.
    A row is dealt 1 + (back + ahead) / block times on average. The block width chooses how the work is dealt,
    never the result.
    """
    at = hours(df, ts)
    first, last = (F.floor((at + d) / block).cast("long") for d in (-ahead, back))
    dealt = df.withColumn("_own", F.floor(at / block).cast("long")).withColumn("_block", F.explode(F.sequence(first, last)))
    window = W.partitionBy(*keys, "_block").orderBy(ts)
    return dealt.withColumns(columns(window)).filter("_block = _own").drop("_block", "_own")


def sequence(df, steps=24, vector="feature_vector", keys=SERIES, ts="ts", block=BLOCK):
    """The last `steps` vectors, oldest first, on a dense hourly grid; incomplete starts are dropped."""
    out = over_blocks(df, lambda w: {"sequence": F.collect_list(vector).over(w.rowsBetween(-(steps - 1), 0))},
                      steps - 1, 0, keys, ts, block)
    return out.filter(F.size("sequence") == steps)


def horizon_targets(df, value="occupancy_ratio", horizons=(1, 2, 4, 8), keys=SERIES, ts="ts", block=BLOCK):
    """`value` some steps later as label columns, on a dense hourly grid; the tail is dropped."""
    out = over_blocks(df, lambda w: {f"target_{h}h": F.lead(value, h).over(w) for h in horizons},
                      0, max(horizons), keys, ts, block)
    return out.filter(F.col(f"target_{max(horizons)}h").isNotNull())


def sequence_and_targets(df, steps=24, vector="feature_vector", value="occupancy_ratio", horizons=(1, 2, 4, 8),
                         keys=SERIES, ts="ts", block=BLOCK):
    """`sequence` and `horizon_targets` over one window, so with one exchange."""
    out = over_blocks(df, lambda w: {"sequence": F.collect_list(vector).over(w.rowsBetween(-(steps - 1), 0)),
                                     **{f"target_{h}h": F.lead(value, h).over(w) for h in horizons}},
                      steps - 1, max(horizons), keys, ts, block)
    return out.filter((F.size("sequence") == steps) & F.col(f"target_{max(horizons)}h").isNotNull())


def _dot(a, b, width):
    total = a[0] * b[0]
    for i in range(1, width):
        total = total + a[i] * b[i]
    return total


def _bind(value, body):
    """`body(value)` with the value computed once per row, also where a lambda uses it many times."""
    return F.transform(F.array(value), body)[0]


def history_attention(df, width=10, out="attended"):
    """The last step attends to all steps: softmax(q . k / sqrt(d)), weighted sum.

    Everything happens inside the row's own array: no self join.
    """
    seq = F.col("sequence")

    def add(acc, p):
        return F.array(acc[0] + p["e"], *[acc[i + 1] + p["e"] * p["x"][i] for i in range(width)])

    def totals(scores, peak):
        parts = F.zip_with(scores, seq, lambda s, x: F.struct(F.exp(s - peak).alias("e"), x.alias("x")))
        return F.aggregate(parts, F.array(*[F.lit(0.0)] * (width + 1)), add)

    scores = _bind(F.element_at(seq, -1),
                   lambda q: F.transform(seq, lambda x: _dot(x, q, width) / math.sqrt(width)))
    total = _bind(scores, lambda s: _bind(F.array_max(s), lambda peak: totals(s, peak)))
    df = df.withColumn("_total", total)
    return (df.withColumn(out, F.array(*[F.col("_total")[i + 1] / F.col("_total")[0] for i in range(width)]))
            .drop("_total"))


def temporal_state(df, k=0.3, width=10, out="state"):
    """Exponentially weighted state: s1 = x1, s_t = k x_t + (1 - k) s_(t-1). Causal by design."""
    seq = F.col("sequence")
    keep = 1.0 - k

    def step(state, x):
        return F.array(*[x[i] * k + state[i] * keep for i in range(width)])

    return df.withColumn(out, F.aggregate(F.slice(seq, 2, F.size(seq)), seq[0], step))

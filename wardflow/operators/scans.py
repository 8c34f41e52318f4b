"""Ordered scans that do not put a whole key into one task.

A plain `sum() over (partition by key order by ts)` sends every row of a key to one task, which
breaks when one department or patient id holds a third of all rows. Each scan here works in three
levels of time inside the key: short slots (a minute), spans of slots (a day or a month), and the spans.

* one partial aggregate per (key, slot), combined map-side, gives the slot's summary;
* a window over the summaries of a (key, span), and one over the spans of a key, give what each slot
  inherits from those before it; both are bounded by time and not by the number of rows;
* the rows are then windowed by (key, slot), so a hot key is spread over its slots.

The inherited values join on (key, slot), the partitioning the rows already have after their window,
so the join adds no exchange of rows. The widths choose how the work is dealt, never the result; every
key is treated alike.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

SLOT, SPAN = "_slot", "_span"


def _prepare(df, keys, ts, slot):
    """Adds the slot and NULL-free copies of the keys; returns their names too."""
    ks = [f"_k{i}" for i in range(len(keys))]
    df = df.withColumns({k: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
                         for k, c in zip(ks, keys)})
    return df.withColumn(SLOT, F.date_trunc(slot, F.col(ts))), ks


def _inherit(rows, carried, ks):
    return rows.join(carried, [*ks, SLOT], "left").drop(*ks, SLOT)


def _carry(summary, ks, span, fold, scan, merge):
    """What each slot inherits: `scan` over the other slots of its span, merged with `scan` over the
    other spans. `fold` gives a span's summary from its slots; all three map columns by name."""
    summary = summary.withColumn(SPAN, F.date_trunc(span, F.col(SLOT)))
    spans = summary.groupBy(*ks, SPAN).agg(*[e.alias(c) for c, e in fold.items()])
    outer = W.partitionBy(*ks).orderBy(SPAN)
    spans = spans.select(*ks, SPAN, *[scan(c, outer).alias(f"_o{c}") for c in fold])
    inner = W.partitionBy(*ks, SPAN).orderBy(SLOT)
    slots = summary.select(*ks, SLOT, SPAN, *[scan(c, inner).alias(f"_i{c}") for c in fold])
    return slots.join(spans, [*ks, SPAN], "left").select(
        *ks, SLOT, *[merge(F.col(f"_i{c}"), F.col(f"_o{c}")).alias(f"_c{c}") for c in fold])


def running_total(df, keys, ts, delta, out, slot="minute", span="day"):
    """`out` = sum of `delta` over all rows of the key up to this time (ties included)."""
    rows, ks = _prepare(df, keys, ts, slot)
    summary = rows.groupBy(*ks, SLOT).agg(F.sum(delta).alias("_sum"))
    carried = _carry(summary, ks, span, {"_sum": F.sum("_sum")},
                     lambda c, w: F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)),
                     lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    inside = W.partitionBy(*ks, SLOT).orderBy(ts).rangeBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn(out, F.sum(delta).over(inside))
    return (_inherit(rows, carried, ks)
            .withColumn(out, F.col(out) + F.coalesce(F.col("_c_sum"), F.lit(0)))
            .drop("_c_sum"))


def fill(df, keys, order, ts, values, slot="minute", span="day", backward=False):
    """Each of `values` becomes its nearest non-null value at or before the row.

    With `backward=True` the search runs to later rows. `order` must be a total order in the key.
    """
    rows, ks = _prepare(df, keys, ts, slot)
    by = F.struct(*order)
    pick, take = (F.min_by, F.first) if backward else (F.max_by, F.last)
    beyond = (1, W.unboundedFollowing) if backward else (W.unboundedPreceding, -1)
    upto = (W.currentRow, W.unboundedFollowing) if backward else (W.unboundedPreceding, W.currentRow)
    summary = rows.groupBy(*ks, SLOT).agg(*[
        pick(F.col(v), F.when(F.col(v).isNotNull(), by)).alias(f"_s_{v}") for v in values])
    fold = {f"_s_{v}": pick(F.col(f"_s_{v}"), F.when(F.col(f"_s_{v}").isNotNull(), F.col(SLOT))) for v in values}
    carried = _carry(summary, ks, span, fold, lambda c, w: take(c, ignorenulls=True).over(w.rowsBetween(*beyond)), F.coalesce)
    inner = W.partitionBy(*ks, SLOT).orderBy(*order).rowsBetween(*upto)
    rows = rows.withColumns({v: take(v, ignorenulls=True).over(inner) for v in values})
    return (_inherit(rows, carried, ks)
            .withColumns({v: F.coalesce(F.col(v), F.col(f"_c_s_{v}")) for v in values})
            .drop(*[f"_c_s_{v}" for v in values]))


def neighbour(df, keys, order, ts, value, out, ahead=True, slot="minute", span="day"):
    """`out` = `value` of the next row of the key (`ahead=False`: of the previous one)."""
    rows, ks = _prepare(df, keys, ts, slot)
    boxed = F.struct(F.col(value).alias("v"))
    edge, shift = (F.min_by, F.lead) if ahead else (F.max_by, F.lag)
    summary = rows.groupBy(*ks, SLOT).agg(edge(boxed, F.struct(*order)).alias("_edge"))
    carried = _carry(summary, ks, span, {"_edge": edge(F.col("_edge"), F.col(SLOT))},
                     lambda c, w: shift(c).over(w), F.coalesce)
    here = shift("_box").over(W.partitionBy(*ks, SLOT).orderBy(*order))
    rows = rows.withColumn("_box", boxed).withColumn("_here", here).drop("_box")
    return (_inherit(rows, carried, ks)
            .withColumn(out, F.coalesce(F.col("_here"), F.col("_c_edge"))["v"])
            .drop("_here", "_c_edge"))


def top_per_key(df, keys, order, n, spread=64):
    """The first `n` rows of each key by `order` (a total order), with their rank in `_rn`.

    Two ranks: first inside `spread` slices of the key by the task that read the row, then over
    the survivors, at most n * spread rows per key. Spark also applies the rank limit before the
    shuffle (WindowGroupLimit), so a task sends n rows of a key, a hot one included.
    """
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(spread)))
    first = W.partitionBy(*keys, "_salt").orderBy(*order)
    kept = salted.withColumn("_rn", F.row_number().over(first)).filter(F.col("_rn") <= n)
    last = W.partitionBy(*keys).orderBy(*order)
    return (kept.drop("_salt").withColumn("_rn", F.row_number().over(last))
            .filter(F.col("_rn") <= n))


def latest_per_key(df, keys, order):
    """Newest row of each key as one aggregate: map tasks send one row per key, a hot key included."""
    rest = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*")

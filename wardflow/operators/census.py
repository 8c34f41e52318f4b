"""Who is present, when. Every form costs one row per movement, however long a stay is."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.functions import scalar as S
from wardflow.operators import scans

UNFOLD = 1024  # ticks of a run made at once


def movements(df):
    """Signed moves per department: +1 arrival, -1 discharge, a transfer is -1 and +1."""
    def move(dept, delta):
        return F.struct(F.col(dept).alias("dept_id"), F.lit(delta).alias("delta"))

    kind = F.col("event_type")
    moves = (F.when(kind == "arrival", F.array(move("dept_id", 1)))
             .when(kind == "discharge", F.array(move("dept_id", -1)))
             .when(kind == "transfer", F.array(move("source_dept_id", -1), move("target_dept_id", 1))))
    return (df.select("hospital_id", F.col("event_ts").alias("ts"), F.explode(moves).alias("m"))
            .select("hospital_id", "ts", "m.dept_id", "m.delta"))


def running_census(df, keys=("hospital_id", "dept_id")):
    """Patients present after each change. Moves at the same instant are netted first."""
    keys = list(keys)
    net = movements(df).groupBy(*keys, "ts").agg(F.sum("delta").alias("net_move"))
    total = scans.running_total(net, keys, "ts", "net_move", "total")
    return total.withColumn("census", F.greatest(F.col("total"), F.lit(0))).drop("total")


def census_at_ticks(stays, tick_minutes=60, start="arrival_ts", los="expected_los_minutes"):
    """Patients present at each tick (arrival <= t < arrival + stay), ticks with nobody left out.

    The interval join is rewritten as +1 at the first covered tick and -1 at the first tick after
    the stay, netted per department and tick before the shuffle. Runs of equal census are then
    unfolded into their ticks. No pair of stay and tick is ever formed, so the cost does not
    depend on the length of a stay.
    """
    step = tick_minutes * 60_000_000
    begin = S.micros(start)
    end = begin + F.floor(F.col(los) * 6e7).cast("long")

    def ceil_tick(us):
        return F.ceil(us / F.lit(step)).cast("long")

    edges = stays.filter(F.col(start).isNotNull() & F.col(los).isNotNull()).select(
        "hospital_id", "dept_id", ceil_tick(begin).alias("first"), ceil_tick(end).alias("stop"))
    net = (edges.filter(F.col("first") < F.col("stop"))
           .select("hospital_id", "dept_id", F.inline(F.array(
               F.struct(F.col("first").alias("k"), F.lit(1).alias("d")),
               F.struct(F.col("stop").alias("k"), F.lit(-1).alias("d")))))
           .groupBy("hospital_id", "dept_id", "k").agg(F.sum("d").alias("d")))
    # one row per department and tick from here on: a grid bounded by time, not by patients
    order = W.partitionBy("hospital_id", "dept_id").orderBy("k")
    runs = net.select("hospital_id", "dept_id", "k",
                      F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("census"),
                      F.lead("k").over(order).alias("next_k"))
    return (runs.filter(F.col("census") > 0)
            .withColumn("to", F.col("next_k") - 1)
            # in pieces, so that no stay, however wrong its length, becomes one long array
            .withColumn("k", F.explode(F.sequence("k", "to", F.lit(UNFOLD).cast("long"))))
            .select("hospital_id", "dept_id",
                    F.explode(F.sequence("k", F.least(F.col("k") + (UNFOLD - 1), "to"))).alias("k"), "census")
            .select("hospital_id", "dept_id", S.from_micros(F.col("k") * step).alias("tick"), "census"))


def with_capacity(df, registry):
    """Capacity of the department; an unknown one counts as the default."""
    caps = registry.select("hospital_id", "dept_id", "capacity")
    return (df.join(caps, ["hospital_id", "dept_id"], "left")
            .withColumn("capacity", F.coalesce("capacity", F.lit(C.DEFAULT_CAPACITY))))


def occupancy(census, registry):
    return with_capacity(census, registry).withColumn(
        "occupancy_ratio", S.clip_unit(F.col("census") / F.col("capacity")))


def dense_spine(registry, start, end, step="1 hour"):
    """Every department at every step. `start` and `end` are columns, such as scalar subqueries.

    Each department row unfolds its own steps: no join at all.
    """
    ticks = F.sequence(start, end, F.expr(f"interval {step}"))
    return registry.select("hospital_id", "dept_id", "ordinal", F.explode(ticks).alias("ts"))


def bounds(df, ts, unit="hour"):
    """First and last step of a table as scalar subqueries, evaluated inside the same job."""
    span = df.agg(F.date_trunc(unit, F.min(ts)).cast("timestamp_ntz").alias("lo"),
                  F.date_trunc(unit, F.max(ts)).cast("timestamp_ntz").alias("hi"))
    return span.select("lo").scalar(), span.select("hi").scalar()


def fill_spine(spine, values, cols, ts="ts"):
    """Values on the spine; gaps become 0."""
    right = values.select("hospital_id", "dept_id", ts, *cols)
    return (spine.join(right, ["hospital_id", "dept_id", ts], "left")
            .withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in cols}))


def expected_end(df, start="arrival_ts", los="expected_los_minutes"):
    return df.withColumn("expected_end", S.add_minutes(start, los))


def overdue_patients(df):
    """Arrivals whose patient has no next arrival or discharge before the expected end."""
    rows = df.filter(F.col("event_type").isin("arrival", "discharge"))
    rows = scans.neighbour(rows, ["hospital_id", "patient_id"], ["event_ts", "event_id"], "event_ts",
                           "event_ts", "next_ts", span="month")
    late = expected_end(rows.filter(F.col("event_type") == "arrival"))
    return (late.filter(F.col("next_ts").isNull() | (F.col("next_ts") >= F.col("expected_end")))
            .select("hospital_id", "patient_id", "dept_id", "event_id", "arrival_ts", "expected_end"))

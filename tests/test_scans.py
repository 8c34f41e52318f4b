"""Skew-safe scans and rewrites against the plain form and brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from wardflow.operators import census, context, features, graph, scans

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one key, one NULL key, tied times, gaps of days."""
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else (None if i % 50 == 1 else f"k{rnd.randrange(200)}")
        ts = T0 + dt.timedelta(minutes=rnd.randrange(0, 60 * 24 * 12, 30))
        if ts.day in (4, 5):
            ts += dt.timedelta(days=3)
        rows.append((i, key, ts, rnd.randrange(-3, 4), rnd.random() if rnd.random() < 0.1 else None))
    df = spark.createDataFrame(rows, "id int, k string, ts timestamp_ntz, d int, v double").repartition(8)
    return df.persist()


def same(a, b):
    cols = sorted(a.columns)
    a, b = a.select(*cols), b.select(*cols)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


MODES = [("minute", "day"), ("hour", "month"), ("day", "year"), ("year", "year")]  # widths never change a result


@pytest.mark.parametrize("width", MODES)
def test_running_total(skewed, width):
    w = W.partitionBy("k").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    same(scans.running_total(skewed, ["k"], "ts", "d", "total", slot=width[0], span=width[1]),
         skewed.withColumn("total", F.sum("d").over(w)))


@pytest.mark.parametrize("slot", ["hour", "month"])
def test_running_total_slots(skewed, slot):
    w = W.partitionBy("k").orderBy("ts").rangeBetween(W.unboundedPreceding, W.currentRow)
    same(scans.running_total(skewed, ["k"], "ts", "d", "total", slot=slot),
         skewed.withColumn("total", F.sum("d").over(w)))


@pytest.mark.parametrize("width", MODES)
@pytest.mark.parametrize("backward", [False, True])
def test_fill(skewed, width, backward):
    w = W.partitionBy("k").orderBy("ts", "id")
    if backward:
        want = F.first("v", ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing))
    else:
        want = F.last("v", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    same(scans.fill(skewed, ["k"], ["ts", "id"], "ts", ["v"], backward=backward, slot=width[0], span=width[1]),
         skewed.withColumn("v", want))


@pytest.mark.parametrize("width", MODES)
@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour(skewed, width, ahead):
    w = W.partitionBy("k").orderBy("ts", "id")
    want = (F.lead if ahead else F.lag)("v").over(w)
    same(scans.neighbour(skewed, ["k"], ["ts", "id"], "ts", "v", "near", ahead=ahead, slot=width[0], span=width[1]),
         skewed.withColumn("near", want))


@pytest.mark.parametrize("n", [1, 5, 288])
def test_top_per_key(skewed, n):
    rn = F.row_number().over(W.partitionBy("k").orderBy(F.col("ts").desc(), "id"))
    same(scans.top_per_key(skewed, ["k"], [F.col("ts").desc(), F.col("id")], n),
         skewed.withColumn("_rn", rn).filter(F.col("_rn") <= n))


def test_latest_per_key(skewed):
    rn = F.row_number().over(W.partitionBy("k").orderBy(F.col("ts").desc(), F.col("id").desc()))
    same(scans.latest_per_key(skewed, ["k"], ["ts", "id"]),
         skewed.withColumn("rn", rn).filter("rn = 1").drop("rn"))


def test_hot_key_is_spread_over_tasks(skewed):
    """No partition of the scan's output holds the hot key whole."""
    out = scans.running_total(skewed, ["k"], "ts", "d", "total")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(_k0" in plan and "_slot" in plan


def test_transfer_panes_equal_sliding_window(spark, tables):
    moved = tables.patients.filter("event_type = 'transfer'")
    plain = (moved.groupBy("hospital_id", F.col("source_dept_id").alias("source_dept"),
                           F.col("target_dept_id").alias("target_dept"), F.window("event_ts", "24 hours", "10 minutes"))
             .agg(F.count("*").alias("transfer_count"))
             .select("hospital_id", "source_dept", "target_dept", F.col("window.end").alias("window_end"), "transfer_count"))
    same(graph.transfer_counts(tables.patients), plain)
    with pytest.raises(ValueError):
        graph.transfer_counts(tables.patients, 25, 10)


def test_census_of_long_and_short_stays(spark):
    """Against brute force, with stays from seconds to weeks and arrivals on the tick."""
    rnd = random.Random(3)
    stays = [("H1", f"H1_{i % 3}", T0 + dt.timedelta(minutes=rnd.choice([0, 60, 61, 90, 1000])),
              rnd.choice([0.5, 30.0, 60.0, 120.0, 1441.5, 20000.0])) for i in range(60)]
    want = {}
    for h, d, a, los in stays:
        t = T0
        while t < a + dt.timedelta(minutes=los):
            if t >= a:
                want[(h, d, t)] = want.get((h, d, t), 0) + 1
            t += dt.timedelta(hours=1)
    df = spark.createDataFrame(stays, "hospital_id string, dept_id string, arrival_ts timestamp_ntz, expected_los_minutes double")
    got = {(r.hospital_id, r.dept_id, r.tick): r.census for r in census.census_at_ticks(df).collect()}
    assert got == want


def test_wait_with_one_placeholder_patient(spark, tables):
    """A third of the events under one patient id; split by day, result as with a plain window."""
    masked = tables.patients.withColumn("patient_id", F.when(F.col("event_id").cast("long") % 3 == 0, "unknown")
                                        .otherwise(F.col("patient_id")))
    w = W.partitionBy("hospital_id", "patient_id").orderBy("event_ts", "event_id")
    plain = masked.withColumn("next_ts", F.lead("event_ts").over(w)).filter("event_type = 'arrival'")
    got = features.wait_minutes(masked)
    same(got.select("event_id", "next_ts"), plain.select("event_id", "next_ts"))


def test_context_join_keeps_rows_without_context(spark):
    f = spark.createDataFrame([("H1", "a", T0), ("H1", "a", T0 + dt.timedelta(days=40)), ("H2", "b", T0)],
                              "hospital_id string, dept_id string, window_end timestamp_ntz")
    c = spark.createDataFrame([("H1", T0, 0.5, None, None, 1), ("H1", T0 + dt.timedelta(hours=1), None, 3.0, None, None)],
                              "hospital_id string, window_end timestamp_ntz, weather_score double, flu_index double, "
                              "traffic_score double, is_severe_weather int")
    rows = {(r.hospital_id, r.window_end): (r.weather_score, r.flu_index, r.traffic_score, r.is_severe_weather)
            for r in context.attach_context(f, c).collect()}
    assert rows == {("H1", T0): (0.5, None, None, 1), ("H1", T0 + dt.timedelta(days=40)): (0.5, 3.0, None, 1),
                    ("H2", T0): (None, None, None, None)}

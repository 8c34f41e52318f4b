"""Shapes of physical plans that matter at scale."""

import os
import re

import pytest
from conftest import SMALL

from wardflow.plans import registry

QUERIES, _ = registry.load()
BATCH = [n for n in ("flow_features", "join_flow_windows", "agg_context", "join_context_asof", "lookup_capacity",
                     "census_interval_join", "census_running", "avg_wait_time", "alert_resolution", "join_predictions_actuals",
                     "dense_spine", "transfer_counts", "resolve_edges", "edge_weights", "node_matrix", "neighbor_mean",
                     "graph_attention", "history_attention", "drift_status", "tick_summary", "forecast_document")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_or_nested_loop_join(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_flow_is_one_scan_and_one_exchange(spark, tables):
    text = plan(QUERIES["flow_features"](spark, SMALL))
    assert (text.count("FileScan"), text.count("Exchange")) == (1, 1)
    assert re.search(r"PushedFilters: \[[^\]]*event_type", text)  # the kind filter reaches the scan
    assert "props" not in text  # unused columns are not read


def test_running_census_scans_once(spark):
    """One scan, and no exchange computed twice: the moves are shuffled once for the rows and the slots'
    sums, the sums by slot once for the slots and the spans. The two second readers reuse them."""
    df = QUERIES["census_running"](spark, SMALL)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert (text.count("FileScan"), text.count("ReusedExchange")) == (1, 2)


def test_rank_limit_runs_before_the_shuffle(spark):
    text = plan(QUERIES["rolling_recent"](spark, SMALL))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_library_text():
    """No hints, no local checkpoints, no cross joins, and no window without partition keys."""
    root = os.path.join(os.path.dirname(__file__), "..", "wardflow")
    banned = r"F\.broadcast\(|localCheckpoint|crossJoin|\bW\.orderBy|randomSplit|\.toPandas\("
    for folder, _, files in os.walk(root):
        for f in files:
            if f.endswith(".py"):
                assert not re.search(banned, open(os.path.join(folder, f)).read()), f


def test_registry_is_broadcast_without_a_hint(spark):
    assert "BroadcastHashJoin" in plan(QUERIES["lookup_capacity"](spark, SMALL))

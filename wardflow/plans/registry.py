"""The table of registered queries."""

from functools import cached_property

from pyspark.sql import functions as F

from wardflow.functions import scalar as S
from wardflow.operators import events as E
from wardflow.operators import features, flow, forecast, graph, scans, serve, census, context
from wardflow.plans.views import oracle
from wardflow.session import staged
from wardflow.sources import feeds, topology

QUERIES = {}
ORACLES = {}


class Tables:
    """Feeds and registry of one data folder."""

    def __init__(self, spark, sf_dir):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def events(self):
        return feeds.read_events(self.spark, self.sf_dir)

    @cached_property
    def patients(self):
        return E.unify_event_time(feeds.patient_events(self.events))

    @cached_property
    def arrivals(self):
        return self.patients.filter(F.col("event_type") == "arrival")

    @cached_property
    def signals(self):
        return feeds.context_events(self.events)

    @cached_property
    def registry(self):
        return topology.departments(self.spark)

    @cached_property
    def hospitals(self):
        return topology.hospitals(self.spark)

    @cached_property
    def edges(self):
        """Edges of the hospitals that appear in the feed."""
        seen = self.patients.select("hospital_id").distinct()
        return serve.restrict_hospitals(topology.edges(self.spark), seen)

    @cached_property
    def bounds(self):
        return census.bounds(self.events, "ts")

    @cached_property
    def flow_1h(self):
        return flow.flow_features(self.patients, "1 hour")

    @cached_property
    def context_30m(self):
        return context.context_windows(self.signals)

    @cached_property
    def features_1h(self):
        """The feature store: written once, read by everything built on it."""
        return staged(features.feature_table(self.patients, self.signals, self.registry, stage=staged),
                      "features")

    @cached_property
    def grid(self):
        return features.node_matrix(self.features_1h, self.registry, *self.bounds)

    @cached_property
    def zgrid(self):
        return self.grid.withColumn("feature_vector", S.zscore_vector("feature_vector"))

    @cached_property
    def occupancy(self):
        return staged(serve.dense_occupancy(self.patients, self.registry, *self.bounds), "occupancy")

    @cached_property
    def weighted_edges(self):
        """A few rows per hospital, joined several times: written once."""
        return staged(graph.edge_weights(self.edges, graph.total_transfers(self.patients)), "edges")

    @cached_property
    def raw_forecasts(self):
        return feeds.raw_forecasts(self.events)

    @cached_property
    def predictions(self):
        """Newest forecast per department and hour."""
        hourly = self.raw_forecasts.withColumn("at", F.col("ts")).withColumn(
            "ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
        last = scans.latest_per_key(hourly, ["hospital_id", "dept_id", "ts"], ["at", "event_id"])
        return forecast.with_peak(last.drop("at"))

    @cached_property
    def last_predictions(self):
        return scans.latest_per_key(self.predictions, ["hospital_id", "dept_id"], ["ts"])


def query(name, sql=None, doubles=""):
    """Registers `fn(tables)` under a name, with its oracle; named columns are rounded to 6 digits."""
    def wrap(fn):
        def run(spark, sf_dir):
            out = fn(Tables(spark, sf_dir))
            return out.withColumns({c: S.display_round(c, 6) for c in doubles.split()})

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = oracle(sql, doubles)
        return fn
    return wrap


def load():
    """Import every catalog once."""
    from wardflow.plans import (batch_events, batch_flow, batch_graph, batch_serve,  # noqa: F401
                                streams)
    return QUERIES, ORACLES

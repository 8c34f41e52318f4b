"""JSON envelopes: rows to (key, value) and back."""

from pyspark.sql import functions as F

from wardflow import config as C
from wardflow.functions import scalar as S
from wardflow.operators import events as E

def encode(df, key="hospital_id"):
    """`value` holds every column as JSON; NULL columns are left out."""
    return df.select(F.col(key).alias("key"), S.json_text("*").alias("value"))


def decode(df, schema):
    """Text or bytes to typed columns. Text that is not JSON gives a row of NULLs."""
    return df.select(F.from_json(F.col("value").cast("string"), schema).alias("d")).select("d.*")


def without_zone(df):
    """Zoned timestamps as plain UTC timestamps, for comparison with batch tables."""
    stamps = [n for n, t in df.dtypes if t == "timestamp"]
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in stamps})


def with_zone(df):
    """Streams need zoned timestamps for their watermark."""
    stamps = [n for n, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({n: F.col(n).cast("timestamp") for n in stamps})


def publish(df, rules, topic, key="hospital_id"):
    """Rows as (topic, key, value): valid ones for `topic`, rejects with their error for the dead-letter
    topic. Kafka partitions by the hash of `key`."""
    ok, dead = E.dead_letter_split(df, rules, topic)
    letter = S.json_text("original_topic", "event_id", "event_type", "error", "payload")
    return encode(ok, key).select(F.lit(topic).alias("topic"), "key", "value").unionByName(
        dead.withColumnRenamed("value", "payload").select(F.lit(C.TOPICS["dead"]).alias("topic"), "key", letter.alias("value")))


def topic_of(kind):
    return C.TOPICS[kind]

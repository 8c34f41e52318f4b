"""Streaming sources. Kafka in production; a folder of (key, value) files stands in elsewhere."""

from wardflow import config as C
from wardflow.schemas import ENVELOPE


def topic_source(spark, topic, options=None, format="kafka", cfg=C.FlowConfig()):
    """(key, value) rows of a topic. Intake per micro-batch is bounded only where the caller asks for it
    (`cfg.max_offsets` for Kafka, maxFilesPerTrigger or maxBytesPerTrigger in `options` for files)."""
    options = dict(options or {})
    if format == "kafka":
        settings = {"subscribe": topic, "startingOffsets": "latest", "failOnDataLoss": "false",
                    **({"maxOffsetsPerTrigger": str(cfg.max_offsets)} if cfg.max_offsets else {}), **options}
        return spark.readStream.format("kafka").options(**settings).load()
    path = options.pop("path")
    return spark.readStream.schema(ENVELOPE).format(format).options(**options).load(path)


def patient_source(spark, options=None, format="kafka", cfg=C.FlowConfig()):
    return topic_source(spark, C.TOPICS["patient"], options, format, cfg)


def context_source(spark, options=None, format="kafka", cfg=C.FlowConfig()):
    return topic_source(spark, C.TOPICS["context"], options, format, cfg)

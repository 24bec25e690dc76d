from tabledeltas.streaming.bronze import (
    TopicSchema,
    decode_topic,
    ingest_topic,
    read_bronze,
    read_rejects,
    stream_bronze,
    topic_schema,
)
from tabledeltas.streaming.jobs import run_streams, run_until_idle
from tabledeltas.streaming.silver import (
    maintain_latest,
    read_changes,
    read_latest,
    register_topic,
    rewrite_latest,
)

__all__ = [
    "TopicSchema",
    "decode_topic",
    "ingest_topic",
    "maintain_latest",
    "read_bronze",
    "read_changes",
    "read_latest",
    "read_rejects",
    "register_topic",
    "rewrite_latest",
    "run_streams",
    "run_until_idle",
    "stream_bronze",
    "topic_schema",
]

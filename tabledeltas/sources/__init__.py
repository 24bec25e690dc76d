from tabledeltas.sources.layout import BRONZE, GOLD, SILVER, Layout
from tabledeltas.sources.sinks import (
    append_sink,
    emit_changes,
    file_sink,
    kafka_sink,
    once,
    to_messages,
    with_headers,
)
from tabledeltas.sources.snapshots import (
    Snapshot,
    SnapshotStore,
    latest_snapshot,
    load_snapshot,
    reject_staged,
    retire_snapshots,
    write_snapshot,
)
from tabledeltas.sources.topics import (
    TOPIC_SCHEMA,
    KafkaTopics,
    RecordedTopics,
    batch_table,
    read_topic,
    streaming_table,
)

__all__ = [
    "BRONZE",
    "GOLD",
    "KafkaTopics",
    "Layout",
    "RecordedTopics",
    "SILVER",
    "Snapshot",
    "SnapshotStore",
    "TOPIC_SCHEMA",
    "append_sink",
    "batch_table",
    "emit_changes",
    "file_sink",
    "kafka_sink",
    "latest_snapshot",
    "load_snapshot",
    "once",
    "read_topic",
    "reject_staged",
    "retire_snapshots",
    "streaming_table",
    "to_messages",
    "with_headers",
    "write_snapshot",
]

from datetime import datetime, timezone
from unittest.mock import MagicMock, patch

import pytest

from tabledeltas.sources import (
    TOPIC_SCHEMA,
    KafkaTopics,
    RecordedTopics,
    append_sink,
    kafka_sink,
    once,
    read_topic,
    with_headers,
)


class Recorder:
    """Stands for a reader or writer and notes what it is told."""

    def __init__(self):
        self.told = {}

    def format(self, name):
        self.told["format"] = name
        return self

    def option(self, name, value):
        self.told[name] = value
        return self

    def options(self, **values):
        self.told.update(values)
        return self

    def load(self):
        return self

    def save(self):
        self.told["saved"] = True


def test_live_topic_is_read_from_its_earliest_record():
    spark = MagicMock(readStream=Recorder())
    source = KafkaTopics("broker:9092", {"maxOffsetsPerTrigger": "1000"})
    assert read_topic(spark, "xx", source).told == {
        "format": "kafka",
        "kafka.bootstrap.servers": "broker:9092",
        "subscribe": "xx",
        "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": "1000",
    }


def test_messages_to_a_live_topic():
    messages = MagicMock(write=Recorder())
    kafka_sink("broker:9092", "changes", {"kafka.acks": "all"})(messages, None)
    assert messages.write.told == {
        "format": "kafka",
        "kafka.bootstrap.servers": "broker:9092",
        "topic": "changes",
        "kafka.acks": "all",
        "saved": True,
    }


@pytest.mark.parametrize("files", [None, 1])
def test_recorded_topic_has_the_columns_of_a_live_one(spark, tmp_path, files):
    spark.createDataFrame([], TOPIC_SCHEMA).write.parquet(str(tmp_path / "xx"))
    stream = read_topic(spark, "xx", RecordedTopics(str(tmp_path), files))
    assert stream.isStreaming and stream.schema == TOPIC_SCHEMA


def test_messages_with_headers_to_a_live_topic(spark):
    run_ts = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    messages = spark.createDataFrame([("k", None)], "key string, value string")
    sent = []

    class Frame:
        write = Recorder()

    def headers(frame, query, at):
        sent.append(with_headers(frame, query, at).first())
        return Frame

    with patch("tabledeltas.sources.sinks.with_headers", headers):
        kafka_sink("broker:9092", "changes", query="q")(messages, run_ts)
    assert Frame.write.told["topic"] == "changes"
    assert {h["key"]: bytes(h["value"]).decode() for h in sent[0]["headers"]} == {
        "query": "q",
        "run_ts": "2024-01-01T12:00:00.000000+00:00",
    }


def test_repeated_messages_are_read_once_over_restarts(spark, tmp_path):
    """Repeated within a run of the reader and after it; another run and another query with the
    same keys are messages of their own."""
    log, out = str(tmp_path / "log"), str(tmp_path / "out")
    days = [datetime(2024, 1, d, 12, tzinfo=timezone.utc) for d in (1, 2)]

    def send(query, run_ts, *rows):
        append_sink(log, query)(spark.createDataFrame(rows, "key string, value string"), run_ts)

    def read():
        stream = once(spark.readStream.schema(spark.read.parquet(log).schema).parquet(log))
        (
            stream.writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "progress"))
            .trigger(availableNow=True)
            .start(out)
            .awaitTermination()
        )
        rows = spark.read.parquet(out).collect()
        return sorted((r["query"], r["run_ts"].day, r["key"], r["value"] or "") for r in rows)

    for _ in range(2):
        send("q", days[0], ("a", "1"), ("b", None))
    first = [("q", 1, "a", "1"), ("q", 1, "b", "")]
    assert read() == first
    send("q", days[0], ("a", "1"))
    send("q", days[1], ("a", "2"))
    send("r", days[0], ("a", "3"))
    assert read() == first + [("q", 2, "a", "2"), ("r", 1, "a", "3")]

"""Change sinks: keyed messages, a null value for a deleted key."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabledeltas.operators.changes import DELETE, key_list, quoted
from tabledeltas.sources.snapshots import as_utc, snapshot_name

#: Headers of a message: the query and the run it belongs to.
QUERY, RUN = "query", "run_ts"
Sink = Callable[[DataFrame, datetime], None]


def to_messages(feed: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """``key`` and ``value`` as JSON text: the row as it is now, or NULL for a delete."""
    keys = F.struct(*[F.col(quoted(k)) for k in key_list(feed, pk)])
    explicit_nulls = {"ignoreNullFields": "false"}
    return feed.select(
        F.to_json(keys, explicit_nulls).alias("key"),
        F.when(F.col("op") != DELETE, F.to_json("after", explicit_nulls)).alias("value"),
    )


def emit_changes(feed: DataFrame, pk: str | Sequence[str], sink: Sink, run_ts: datetime) -> None:
    """Send upserts and deletes in one distributed write; a key has one message per run."""
    sink(to_messages(feed, pk), run_ts)


def file_sink(path: str, format: str = "parquet") -> Sink:
    """One directory per run, replaced when a run is emitted again."""

    def write(messages: DataFrame, run_ts: datetime) -> None:
        messages.write.mode("overwrite").format(format).save(f"{path}/{snapshot_name(run_ts)}")

    return write


def append_sink(path: str, query: str, format: str = "parquet") -> Sink:
    """One growing log of messages with headers, at least once: a run emitted again is there
    twice, and ``once`` reads it once."""

    def write(messages: DataFrame, run_ts: datetime) -> None:
        with_headers(messages, query, run_ts).write.mode("append").format(format).save(path)

    return write


def kafka_sink(
    bootstrap_servers: str,
    topic: str,
    options: Mapping[str, str] | None = None,
    query: str | None = None,
) -> Sink:
    """Messages to a topic, at least once; with headers if the query's name is given."""

    def write(messages: DataFrame, run_ts: datetime) -> None:
        (
            (messages if query is None else with_headers(messages, query, run_ts))
            .write.format("kafka")
            .option("kafka.bootstrap.servers", bootstrap_servers)
            .option("topic", topic)
            .options(**(options or {}))
            .save()
        )

    return write


def with_headers(messages: DataFrame, query: str, run_ts: datetime) -> DataFrame:
    """Add what tells a message from its repetitions, as Kafka headers."""
    values = {QUERY: query, RUN: as_utc(run_ts).isoformat(timespec="microseconds")}
    headers = [
        F.struct(F.lit(name).alias("key"), F.lit(value).cast("binary").alias("value"))
        for name, value in values.items()
    ]
    return messages.withColumn("headers", F.array(*headers))


def once(messages: DataFrame, repeated_within: str = "7 days") -> DataFrame:
    """``query, run_ts, key, value`` of a stream of messages with headers, each message once.

    Spark keeps the keys of a run until a run newer by ``repeated_within`` was read. A message
    repeated, or first delivered, after that is dropped as late.
    """

    def header(name: str) -> Column:
        found = F.filter("headers", lambda h: h["key"] == name)
        return F.get(found, F.lit(0))["value"].cast("string")

    return (
        messages.select(
            header(QUERY).alias(QUERY),
            header(RUN).cast("timestamp").alias(RUN),
            F.col("key").cast("string").alias("key"),
            F.col("value").cast("string").alias("value"),
        )
        .withWatermark(RUN, repeated_within)
        .dropDuplicatesWithinWatermark([QUERY, RUN, "key"])
    )

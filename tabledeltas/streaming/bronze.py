"""Bronze: one append-only table per topic, decoded, with what did not decode set apart.

    <bronze topic>/rows/stream=<id>/batch_id=<n>/rejected=<bool>/

There is no log of files: what a batch wrote is one directory, found by its name.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tabledeltas.functions.avro_schema import avro_struct, is_avro
from tabledeltas.functions.envelope import (
    REJECT_SCHEMA,
    AvroCodec,
    JsonCodec,
    decode_envelope,
    latest_schemas,
)
from tabledeltas.functions.envelope import rejected as reject_rows
from tabledeltas.sources import files
from tabledeltas.sources.batches import PARTITIONS, start_batches, write_batch
from tabledeltas.sources.layout import BRONZE, Layout
from tabledeltas.sources.topics import (
    TOPIC_SCHEMA,
    KafkaTopics,
    RecordedTopics,
    batch_table,
    read_topic,
    streaming_table,
)

# A query without a trigger starts the next micro-batch as soon as the last one is done.
DEFAULT_TRIGGER: Mapping[str, object] = {"processingTime": "0 seconds"}


@dataclass(frozen=True)
class TopicSchema:
    """Schemas and codecs of a topic, frozen for a run."""

    key: T.StructType
    value: T.StructType
    key_codec: JsonCodec | AvroCodec = JsonCodec()
    value_codec: JsonCodec | AvroCodec = JsonCodec()

    def bronze_schema(self) -> T.StructType:
        """Topic columns with ``key`` and ``value`` as structs, the reject, and the partitions."""
        decoded = {"key": self.key, "value": self.value}
        fields = [
            T.StructField(f.name, decoded.get(f.name, f.dataType)) for f in TOPIC_SCHEMA.fields
        ]
        return T.StructType(
            [
                *fields,
                T.StructField("_reject", REJECT_SCHEMA),
                *PARTITIONS,
                T.StructField("rejected", T.BooleanType()),
            ]
        )


def topic_schema(schemas: DataFrame, topic: str, json_bodies: bool = False) -> TopicSchema:
    """What a schema table ``(topic, side, version, schema_id, schema)`` says of a topic of
    framed JSON, ``schema`` being the JSON of a Spark schema, or of framed Avro, ``schema``
    being the text of an Avro record. Both sides of a topic may differ, the versions of one
    side may not. ``json_bodies`` is for topics whose Avro records are framed as JSON.

    The newest version of each side is the topic's schema. Every registered version may have
    written records; those are the few rows that come to the driver.
    """
    of_topic = schemas.where(F.col("topic") == topic)
    newest = {r["side"]: r["schema"] for r in latest_schemas(of_topic).collect()}
    missing = {"key", "value"} - newest.keys()
    if missing:
        raise ValueError(f"topic {topic!r} has no schema for its {' and '.join(sorted(missing))}")
    writers: dict[str, dict[int, str]] = {"key": {}, "value": {}}
    for row in of_topic.select("side", "schema_id", "schema").distinct().collect():
        writers[row["side"]][row["schema_id"]] = row["schema"]
    return TopicSchema(
        _struct(newest["key"]),
        _struct(newest["value"]),
        _codec(newest["key"], writers["key"], json_bodies),
        _codec(newest["value"], writers["value"], json_bodies),
    )


def _struct(text: str) -> T.StructType:
    parsed = json.loads(text)
    return avro_struct(text) if is_avro(parsed) else T.StructType.fromJson(parsed)


def _codec(newest: str, writers: Mapping[int, str], json_bodies: bool) -> JsonCodec | AvroCodec:
    kinds = {is_avro(json.loads(text)) for text in [newest, *writers.values()]}
    if len(kinds) > 1:
        raise ValueError("the versions of a schema are partly Avro records, partly Spark structs")
    if kinds == {True} and not json_bodies:
        return AvroCodec(newest, dict(writers))
    return JsonCodec(framed=True, writers={i: _struct(text) for i, text in writers.items()})


def decode_topic(records: DataFrame, schema: TopicSchema) -> DataFrame:
    """Key first, then value; works on a batch and on a stream."""
    keyed = decode_envelope(records, "key", schema.key, schema.key_codec, required=True)
    return decode_envelope(keyed, "value", schema.value, schema.value_codec)


def ingest_topic(
    spark: SparkSession,
    topic: str,
    source: KafkaTopics | RecordedTopics,
    schema: TopicSchema,
    layout: Layout,
    trigger: Mapping[str, object] = DEFAULT_TRIGGER,
) -> StreamingQuery:
    """Start the stream that lands a topic. Records are appended once across restarts.

    Rows that do not decode go to a partition of their own in the same write, so the topic
    is read once and readers of the good rows never open the others.
    """
    decoded = decode_topic(read_topic(spark, topic, source), schema)
    path = layout.of(BRONZE, topic).rows

    def write(batch: DataFrame, stream: str, batch_id: int) -> None:
        judged = batch.withColumn("rejected", F.col("_reject").isNotNull())
        write_batch(judged, path, stream, batch_id, ["rejected"])

    writer = (
        decoded.writeStream.queryName(f"bronze_{topic}")
        .option("checkpointLocation", layout.of(BRONZE, topic).progress)
        .trigger(**trigger)
    )
    return start_batches(writer, write)


def read_bronze(spark: SparkSession, layout: Layout, topic: str, schema: TopicSchema) -> DataFrame:
    """The decoded records of a topic as a batch."""
    return _good(_landed(spark, layout, topic, schema))


def stream_bronze(
    spark: SparkSession,
    layout: Layout,
    topic: str,
    schema: TopicSchema,
    max_files_per_trigger: int | None = None,
    archive: bool = False,
) -> DataFrame:
    """The decoded records of a topic as a stream.

    With ``archive`` Spark moves the files it is done with out of the folder that every batch
    lists, so that the list stays short however old the topic is. It is for the one stream that
    owns the topic's bronze table; ``read_bronze`` reads both places.
    """
    options: dict[str, object] = {}
    if max_files_per_trigger is not None:
        options["maxFilesPerTrigger"] = max_files_per_trigger
    paths = layout.of(BRONZE, topic)
    if archive:
        options |= {"cleanSource": "archive", "sourceArchiveDir": paths.archive}
    return _good(streaming_table(spark, paths.rows, schema.bronze_schema(), **options))


def read_rejects(spark: SparkSession, layout: Layout, topic: str, schema: TopicSchema) -> DataFrame:
    """Records that did not decode: where they came from, why, and their raw payload."""
    rows = _landed(spark, layout, topic, schema)
    return reject_rows(rows.where("rejected").drop("rejected", *[f.name for f in PARTITIONS]))


def _landed(spark: SparkSession, layout: Layout, topic: str, schema: TopicSchema) -> DataFrame:
    paths = layout.of(BRONZE, topic)
    rows = batch_table(spark, paths.rows, schema.bronze_schema())
    # Spark archives a file below its whole former path.
    archived = paths.archive + files.bare(spark, paths.rows)
    if files.exists(spark, archived):
        rows = rows.unionByName(batch_table(spark, archived, schema.bronze_schema()))
    return rows


def _good(rows: DataFrame) -> DataFrame:
    return rows.where("NOT rejected").drop("rejected", "_reject", *[f.name for f in PARTITIONS])

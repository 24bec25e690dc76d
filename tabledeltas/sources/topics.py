"""Topic streams with the columns of Spark's Kafka source, from brokers or from files."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TOPIC_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType()),
        T.StructField("value", T.BinaryType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("timestampType", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class KafkaTopics:
    """Live topics. ``options`` go to the source as they are, e.g. ``maxOffsetsPerTrigger``."""

    bootstrap_servers: str
    options: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class RecordedTopics:
    """Topics recorded as parquet under ``<base>/<topic>``, for replay without brokers."""

    base: str
    max_files_per_trigger: int | None = None


def read_topic(spark: SparkSession, topic: str, source: KafkaTopics | RecordedTopics) -> DataFrame:
    """Stream one topic from its earliest record."""
    if isinstance(source, KafkaTopics):
        return (
            spark.readStream.format("kafka")
            .option("kafka.bootstrap.servers", source.bootstrap_servers)
            .option("subscribe", topic)
            .option("startingOffsets", "earliest")
            .options(**source.options)
            .load()
        )
    reader = spark.readStream.schema(TOPIC_SCHEMA)
    if source.max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", source.max_files_per_trigger)
    return reader.parquet(f"{source.base.rstrip('/')}/{topic}")


def batch_table(
    spark: SparkSession, path: str, schema: T.StructType | None = None, format: str = "parquet"
) -> DataFrame:
    reader = spark.read.format(format)
    return (reader if schema is None else reader.schema(schema)).load(path)


def streaming_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    format: str = "parquet",
    **options: object,
) -> DataFrame:
    reader = spark.readStream.format(format).options(**options)
    return (reader if schema is None else reader.schema(schema)).load(path)

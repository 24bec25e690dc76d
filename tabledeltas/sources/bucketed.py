"""Parquet directories clustered into hash buckets of a key.

Spark learns the bucketing from a catalog entry, which is made for the moment of writing or
of resolving the read and dropped again; the table is external, so its files stay. Reads with
equal keys and bucket counts are joined, grouped and united on the key without a shuffle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledeltas.operators.changes import quoted
from tabledeltas.sources import files


# Default size of a bucket, which is read by one task.
BYTES_PER_BUCKET = 512 * 1024 * 1024


def enough_buckets(
    spark: SparkSession,
    buckets: int,
    paths: Sequence[str],
    bytes_per_bucket: int = BYTES_PER_BUCKET,
) -> int:
    """``buckets``, doubled until the data of ``paths`` fits them."""
    held = sum(files.size(spark, path) for path in paths)
    while held > buckets * bytes_per_bucket:
        buckets *= 2
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    if buckets > most:
        raise ValueError(
            f"{held} bytes need {buckets} buckets of {bytes_per_bucket} bytes, but "
            f"spark.sql.sources.bucketing.maxBuckets is {most}: raise one of the two"
        )
    return buckets


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def to_buckets(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """Bring the rows of each bucket together."""
    return df.repartition(buckets, *[F.col(quoted(k)) for k in keys])


def write_bucketed(df: DataFrame, keys: Sequence[str], path: str, buckets: int) -> None:
    """Write rows that ``to_buckets`` brought together, one file per bucket.

    Fails if the path already holds data. Rows are not sorted within a bucket: the join
    sorts a bucket faster than the writer does. The catalog entry is made in the current database.
    """
    spark = df.sparkSession
    table = _table_name()
    try:
        (
            df.write.format("parquet")
            .mode("errorifexists")
            .option("path", files.qualified(spark, path))
            .bucketBy(buckets, *keys)
            .saveAsTable(table)
        )
    finally:
        _forget(spark, table)


def read_bucketed(
    spark: SparkSession,
    keys: Sequence[str],
    path: str,
    buckets: int,
    schema: str,
) -> DataFrame:
    """Read such a directory; ``schema`` is JSON, as there may be no file to read it from."""
    columns = T.StructType.fromJson(json.loads(schema)).toNullable().toDDL()
    clustered = ", ".join(quoted(k) for k in keys)
    location = files.qualified(spark, path).replace("\\", "\\\\").replace("'", "\\'")
    table = _table_name()
    try:
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet "
            f"CLUSTERED BY ({clustered}) INTO {buckets} BUCKETS LOCATION '{location}'"
        )
        # The relation is resolved here: the frame outlives the catalog entry.
        return spark.table(table)
    finally:
        _forget(spark, table)


def _table_name() -> str:
    return f"tabledeltas_{uuid.uuid4().hex}"


def _forget(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")

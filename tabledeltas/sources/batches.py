"""Output of a stream as one directory per micro-batch, ``stream=<id>/batch_id=<n>``.

A micro-batch that Spark runs again after a failure has the same records under the same number.
If its directory is complete it is left alone, else it is written anew: so each batch is kept
once, with no log beside the data. Spark discovers stream and number as partition columns.

The id is that of the stream's checkpoint: a stream that lost its checkpoint counts from 0
again, and does so in a directory of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from tabledeltas.sources import files

STREAM, BATCH = "stream", "batch_id"
PARTITIONS = (T.StructField(STREAM, T.StringType()), T.StructField(BATCH, T.LongType()))
#: Spark leaves this file where a job's output is complete.
SUCCESS = "_SUCCESS"


def batch_path(path: str, stream: str, batch_id: int) -> str:
    return f"{path}/{STREAM}={stream}/{BATCH}={batch_id}"


def write_batch(
    rows: DataFrame,
    path: str,
    stream: str,
    batch_id: int,
    partition_by: Sequence[str] = (),
    stateful: bool = False,
) -> None:
    """Keep one micro-batch, once. A ``stateful`` one is evaluated even if it is there already,
    for its state has to be brought up to it."""
    target = batch_path(path, stream, batch_id)
    if not files.exists(rows.sparkSession, f"{target}/{SUCCESS}"):
        rows.write.mode("overwrite").partitionBy(*partition_by).parquet(target)
    elif stateful:
        rows.write.format("noop").mode("overwrite").save()


def complete_batches(spark: SparkSession, path: str) -> list[str]:
    """Directories of whole micro-batches below ``path``, oldest first. ``path`` may be a glob."""
    marks = files.oldest_first(spark, f"{path}/{STREAM}=*/{BATCH}=*/{SUCCESS}")
    return [mark.removesuffix(f"/{SUCCESS}") for mark in marks]


def start_batches(
    writer: DataStreamWriter, write: Callable[[DataFrame, str, int], None]
) -> StreamingQuery:
    """Start a stream whose micro-batches go to ``write(rows, stream, batch_id)``."""
    stream: Future[str] = Future()  # known once started, which the first batch waits for
    query = writer.foreachBatch(lambda rows, n: write(rows, stream.result(), n)).start()
    stream.set_result(str(query.id))
    return query

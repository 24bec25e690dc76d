"""Silver: the latest value per key, kept up to date by a stream.

Every micro-batch is kept as a directory of its own, folded, with only the keys it changed:

    <silver topic>/rows/epoch=<e>/stream=<id>/batch_id=<n>/

The table is the fold of the directories of the newest epoch. Folding is idempotent and
order-free: a batch that is run again, or a stream that lost its checkpoint and starts over,
does not change it. After ``fold_every`` batches one ordinary Spark job folds the epoch into the
first directory of the next, so what is listed and read does not grow with the stream's age.

By default no state is kept: a micro-batch is folded alone, and the orders in the table decide
which value is newer. With ``stateful`` Spark's own state store holds the latest value of every
key, so that a batch holds, for the keys it touches, what is latest over the whole stream.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tabledeltas.operators.latest import as_table, fold_latest, project_value
from tabledeltas.sources import files
from tabledeltas.sources.batches import BATCH, complete_batches, start_batches, write_batch
from tabledeltas.sources.layout import SILVER, Layout
from tabledeltas.streaming.bronze import DEFAULT_TRIGGER

EPOCH = "epoch="
#: Stands for a stream's id in the directory that an epoch begins with.
FOLDED = "folded"
#: Column of the rows of a topic that is ordered by offset alone.
PARTITION = "partition"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
}


@dataclass(frozen=True)
class _Live:
    """What counts of a table now: an epoch and its complete directories, oldest first."""

    epoch: int = 0
    parts: tuple[str, ...] = ()


def maintain_latest(
    spark: SparkSession,
    records: DataFrame,
    layout: Layout,
    topic: str,
    keys: Mapping[str, str],
    order_by: str | Sequence[str] = "offset",
    fold_every: int = 50,
    keep_epochs: int = 2,
    stateful: bool = False,
    trigger: Mapping[str, object] = DEFAULT_TRIGGER,
) -> StreamingQuery:
    """Start the stream that keeps a topic's latest values.

    After ``fold_every`` micro-batches the table is rewritten as one folded directory. The
    newest ``keep_epochs`` epochs are kept, for those who began to read an older one.
    ``stateful`` keeps the latest value of every key in RocksDB, beside the checkpoint.
    """
    if fold_every < 2:
        raise ValueError("fold_every must be at least 2")
    path = layout.of(SILVER, topic).rows

    def fold(rows: DataFrame) -> DataFrame:
        return fold_latest(rows, keys, order_by=order_by, keep_partition=True)

    def write(batch: DataFrame, stream: str, batch_id: int) -> None:
        session = batch.sparkSession
        live = _live(session, path)
        if len(live.parts) > fold_every:
            rewrite_latest(session, layout, topic, list(keys), keep_epochs)
            live = _live(session, path)
        rows = batch if stateful else fold(batch)
        write_batch(rows, _epoch(path, live.epoch), stream, batch_id, stateful=stateful)

    writer = (
        (fold(records) if stateful else records)
        .writeStream.queryName(f"silver_{topic}")
        .outputMode("update")
        .option("checkpointLocation", layout.of(SILVER, topic).progress)
        .trigger(**trigger)
    )
    if not stateful:
        return start_batches(writer, write)
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    try:
        for name, value in STATE_STORE.items():
            spark.conf.set(name, value)
        return start_batches(writer, write)  # a stream keeps the settings it was started with
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def rewrite_latest(
    spark: SparkSession, layout: Layout, topic: str, keys: Sequence[str], keep_epochs: int = 2
) -> None:
    """Begin a new epoch with the fold of the present one, and drop the oldest.

    For the owner of the table, between micro-batches. A rewrite that fails leaves a directory
    that is not complete, which readers pass over and the next rewrite replaces.
    """
    path = layout.of(SILVER, topic).rows
    live = _live(spark, path)
    write_batch(_read(spark, live, list(keys)), _epoch(path, live.epoch + 1), FOLDED, 0)
    for name in files.child_directories(spark, path):
        if int(name.removeprefix(EPOCH)) <= live.epoch + 1 - keep_epochs:
            files.delete(spark, f"{path}/{name}")


def read_latest(
    spark: SparkSession,
    layout: Layout,
    topic: str,
    keys: Sequence[str],
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """``(<keys>, value, ord)`` as of the last complete micro-batch.

    A deleted key is a row with a null value. ``fields`` limits the value to some of its
    fields; the others are then neither read nor shuffled.
    """
    live = _live_of(spark, layout, topic)
    return _read(spark, live, list(keys), fields).drop(PARTITION)


def read_changes(spark: SparkSession, layout: Layout, topic: str) -> DataFrame:
    """The rows of the present epoch as the micro-batches kept them, with ``batch_id``."""
    live = _live_of(spark, layout, topic)
    base = _epoch(layout.of(SILVER, topic).rows, live.epoch)
    parts = [p for p in live.parts if f"={FOLDED}/" not in p]
    rows = spark.read.schema(spark.read.parquet(live.parts[-1]).schema.add(BATCH, "long"))
    return rows.option("basePath", base).parquet(*parts).drop(PARTITION, "stream")


def register_topic(
    spark: SparkSession,
    layout: Layout,
    topic: str,
    keys: Sequence[str],
    fields: Sequence[str] | None = None,
    name: str | None = None,
) -> DataFrame:
    """Make a topic's current table a view under the topic's name."""
    table = as_table(read_latest(spark, layout, topic, keys, fields), keys)
    table.createOrReplaceTempView(name or topic)
    return table


def _epoch(path: str, number: int) -> str:
    return f"{path}/{EPOCH}{number:08d}"  # of one width, so that names sort by number


def _live(spark: SparkSession, path: str) -> _Live:
    """The newest epoch that begins with a whole fold, else the first one."""
    for name in reversed(files.child_directories(spark, path)):
        parts = tuple(complete_batches(spark, f"{path}/{name}"))
        number = int(name.removeprefix(EPOCH))
        if number == 0 or any(f"={FOLDED}/" in p for p in parts):
            return _Live(number, parts)
    return _Live()


def _live_of(spark: SparkSession, layout: Layout, topic: str) -> _Live:
    live = _live(spark, layout.of(SILVER, topic).rows)
    if not live.parts:
        raise FileNotFoundError(f"topic {topic!r} has no committed micro-batch yet")
    return live


def _read(
    spark: SparkSession, live: _Live, keys: list[str], fields: Sequence[str] | None = None
) -> DataFrame:
    # The newest schema reads older parts too: a field they lack is NULL there.
    rows = spark.read.schema(spark.read.parquet(live.parts[-1]).schema).parquet(*live.parts)
    if fields is not None:
        rows = project_value(rows, fields)
    if len(live.parts) == 1:
        return rows  # folded as it is
    partition = PARTITION if PARTITION in rows.columns else None
    return fold_latest(
        rows, {k: k for k in keys}, order_by="ord", partition=partition, keep_partition=True
    )

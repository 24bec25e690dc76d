"""Latest value per key, and the topic table made from it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledeltas.operators.changes import quoted


def project_value(df: DataFrame, fields: Sequence[str], column: str = "value") -> DataFrame:
    """Keep only ``fields`` of a struct column; a null struct stays null.

    A struct built over a null struct is a non-null struct of nulls, which would turn a
    tombstone into a row, hence the guard. Projecting before the fold keeps unused fields
    out of both the scan and the shuffle.
    """
    kept = F.struct(*[F.col(f"{column}.{quoted(f)}").alias(f) for f in fields])
    return df.withColumn(column, F.when(F.col(column).isNotNull(), kept))


def fold_latest(
    df: DataFrame,
    keys: Mapping[str, str],
    value: str = "value",
    order_by: str | Sequence[str] = "offset",
    partition: str | None = None,
    keep_partition: bool = False,
) -> DataFrame:
    """One row per key, ``(<keys>, value, ord)``: the value with the greatest order.

    ``keys`` maps output names to input columns, e.g. ``{"userid": "key.userId"}``. A null
    value wins like any other and stays null, which is how a delete is kept. ``order_by``
    must decide between the rows of a key; a null in it fails the job, because such a row
    would otherwise be skipped.

    Offsets compare within a partition only. Where they alone are the order and there is a
    ``partition`` column (or another is named), a key found in two partitions fails the job:
    after a topic got more partitions, an older value would win for ever. Order such a topic by
    time. ``keep_partition`` adds the key's partition, for folds of the result to be checked.

    Rows of a key are combined within each task before the shuffle, so a hot key costs one
    row per task. Folding is idempotent and order-free: folding folds, in any grouping and
    with repeats, gives the fold of everything.
    """
    names = [order_by] if isinstance(order_by, str) else list(order_by)
    columns = [F.col(n) for n in names]
    ordering = columns[0] if len(columns) == 1 else F.struct(*columns)
    undecided = reduce(Column.__or__, [c.isNull() for c in columns])
    checked = F.when(
        undecided, F.raise_error(F.lit(f"null order in {names}: the latest row is undecided"))
    ).otherwise(ordering)
    if partition is None and names == ["offset"] and "partition" in df.columns:
        partition = "partition"
    rows = df.select(
        *[F.col(source).alias(name) for name, source in keys.items()],
        F.col(value).alias("value"),
        checked.alias("ord"),
        *([] if partition is None else [F.col(partition).alias("partition")]),
    )
    newest = F.max_by("value", "ord").alias("value"), F.max("ord").alias("ord")
    folded = rows.groupBy(*[F.col(quoted(k)) for k in keys])
    if partition is None:
        return folded.agg(*newest)
    folded = folded.agg(*newest, F.min("partition").alias("_low"), F.max("partition").alias("_high"))
    moved = F.raise_error(
        F.lit(f"a key is in two partitions, where offsets do not compare: order by more than {names}")
    )
    columns = [
        F.when(F.col("_low") != F.col("_high"), moved).otherwise(F.col(c)).alias(c)
        for c in ("value", "ord")
    ]
    last = [F.col("_high").alias("partition")] if keep_partition else []
    return folded.select(*[F.col(quoted(k)) for k in keys], *columns, *last)


def as_table(df: DataFrame, keys: Sequence[str] = (), column: str = "value") -> DataFrame:
    """The rows that are not deleted, with the fields of the value as columns.

    Fields named like one of ``keys`` are taken from the key column of the fold. Spark
    knows how that column is partitioned, so a join on it needs no second shuffle.
    """
    dtype = df.schema[column].dataType
    if not isinstance(dtype, T.StructType):
        raise TypeError(f"column {column!r} must be a struct, found {dtype.simpleString()}")
    own = {k.lower(): k for k in keys}
    return df.where(F.col(column).isNotNull()).select(
        *[
            F.col(quoted(own[f.name.lower()])).alias(f.name)
            if f.name.lower() in own
            else F.col(f"{column}.{quoted(f.name)}").alias(f.name)
            for f in dtype.fields
        ]
    )

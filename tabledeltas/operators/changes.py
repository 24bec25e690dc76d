"""Keyed comparison of two results: inserts, updates, deletes and the one-pass change feed."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INSERT, UPDATE, DELETE = "I", "U", "D"


class KeyViolation(ValueError):
    """The declared key is null or not unique."""


class SchemaChange(ValueError):
    """A column of the previous result was dropped or changed its type."""


def key_list(df: DataFrame, pk: str | Sequence[str]) -> list[str]:
    """Key names as ``df`` spells them; a missing key column is an error naming it."""
    names = [pk] if isinstance(pk, str) else list(pk)
    if not names:
        raise ValueError("at least one key column is needed")
    spelled = {c.lower(): c for c in df.columns}
    missing = [n for n in names if n.lower() not in spelled]
    if missing:
        raise ValueError(f"key column {missing} not in {df.columns}")
    return [spelled[n.lower()] for n in names]


# --- joins on the key alone ---------------------------------------------------------------


def _left_only(lhs: DataFrame, rhs: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    # A null key matches nothing, so null-keyed rows stay, as they would under an outer
    # join filtered on IS NULL. Only the right side's key columns are shuffled.
    keys = key_list(lhs, pk)
    right = rhs.select(*[F.col(quoted(k)) for k in key_list(rhs, pk)]).toDF(*keys)
    return lhs.join(right, keys, "left_anti")


def inserts(previous: DataFrame, latest: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """Rows of ``latest`` whose key is not in ``previous``."""
    return _left_only(latest, previous, pk)


def deletes(previous: DataFrame, latest: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """Rows of ``previous`` whose key is not in ``latest``."""
    return _left_only(previous, latest, pk)


def updates(
    previous: DataFrame,
    latest: DataFrame,
    pk: str | Sequence[str],
    null_safe: bool = True,
) -> DataFrame:
    """Rows of ``latest`` whose key is in ``previous`` with some other column changed.

    ``null_safe=False`` compares with plain ``=``: a row whose only change is to or from
    NULL then compares as unknown and is left out.
    """
    previous = align(previous, latest.schema)
    keys = key_list(latest, pk)
    others = [f for f in latest.schema.fields if f.name not in keys]
    l, p = latest.alias("l"), previous.alias("p")
    same_key = reduce(Column.__and__, [side("l", k) == side("p", k) for k in keys])
    if not others:
        return latest.where(F.lit(False))
    if null_safe:
        changed = ~_row("l", others).eqNullSafe(_row("p", others))
    else:
        pairs = [
            comparable(side("l", f.name), f.dataType) == comparable(side("p", f.name), f.dataType)
            for f in others
        ]
        changed = ~reduce(Column.__and__, pairs)
    return l.join(p, same_key, "inner").where(changed).select("l.*")


# --- one pass -----------------------------------------------------------------------------


def change_feed(
    previous: DataFrame,
    latest: DataFrame,
    pk: str | Sequence[str],
    null_safe: bool = True,
    run_ts: datetime | None = None,
) -> DataFrame:
    """All changes from ``previous`` to ``latest`` as ``op, <key>, before, after[, run_ts]``.

    One full outer join replaces an anti join each way and an inner join. Each side carries
    its row as one struct, which is null exactly where that side has no such key.
    Keys must be unique (``assert_key``); a null key fails the job.
    """
    previous = align(previous, latest.schema)
    keys = key_list(latest, pk)
    reserved = {"op", "before", "after", "run_ts"} & {k.lower() for k in keys}
    if reserved:
        raise ValueError(f"a key column must not be named {sorted(reserved)}: feed columns")
    others = [f for f in latest.schema.fields if f.name not in keys]
    before, after = _packed(previous, keys, "before"), _packed(latest, keys, "after")
    both = before.join(after, keys, "full")

    if not others:
        changed = F.lit(False)
    elif null_safe:
        changed = ~_row("after", others).eqNullSafe(_row("before", others))
    else:
        pairs = [
            comparable(side("after", f.name), f.dataType)
            == comparable(side("before", f.name), f.dataType)
            for f in others
        ]
        changed = F.coalesce(~reduce(Column.__and__, pairs), F.lit(False))

    op = (
        F.when(any_null(keys), F.raise_error(F.lit(f"null key in {keys}")))
        .when(F.col("before").isNull(), INSERT)
        .when(F.col("after").isNull(), DELETE)
        .when(changed, UPDATE)
    )
    feed = both.withColumn("op", op).where(F.col("op").isNotNull())
    columns = [F.col("op"), *[F.col(quoted(k)) for k in keys], F.col("before"), F.col("after")]
    if run_ts is not None:
        columns.append(F.lit(run_ts).cast("timestamp").alias("run_ts"))
    return feed.select(*columns)


def apply_changes(previous: DataFrame, feed: DataFrame, pk: str | Sequence[str]) -> DataFrame:
    """``previous`` with a change feed applied; the inverse of ``change_feed``.

    Only the feed's keys meet the previous rows, so where the feed is small the previous
    rows need not be shuffled.
    """
    after = feed.schema["after"].dataType
    keys = key_list(previous, pk)
    touched = feed.select(*[F.col(quoted(k)) for k in key_list(feed, pk)]).toDF(*keys)
    kept = previous.join(touched, keys, "left_anti")
    written = feed.where(F.col("op").isin(INSERT, UPDATE)).select("after.*")
    return align(kept, after).unionByName(written)


def key_stats(df: DataFrame, pk: str | Sequence[str]) -> tuple[int, int, int]:
    """``(rows, rows with a null key, keys held by more than one row)``, in one job.

    Rows are counted per key before the shuffle, so a hot key is one row per task.
    """
    keys = key_list(df, pk)
    per_key = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(F.count(F.lit(1)).alias("_n"))
    null_key = any_null(keys)
    row = per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(null_key, F.col("_n"))), F.lit(0)).alias("nulls"),
        F.count(F.when((F.col("_n") > 1) & ~null_key, 1)).alias("repeated"),
    ).first()
    return row["rows"], row["nulls"], row["repeated"]


def assert_key(df: DataFrame, pk: str | Sequence[str]) -> int:
    """Reject a null or repeated key; return the number of rows."""
    rows, nulls, repeated = key_stats(df, pk)
    if nulls or repeated:
        raise KeyViolation(
            f"key {pk} is not a key: {nulls} rows with a null key, {repeated} repeated keys"
        )
    return rows


# --- comparison helpers -------------------------------------------------------------------


def align(previous: DataFrame, latest: T.StructType) -> DataFrame:
    """``previous`` in the columns of the latest schema: an added column is NULL there.

    A dropped or retyped column is an error naming it. Nullability may differ.
    """
    old = {f.name.lower(): f for f in previous.schema.fields}
    new = {f.name.lower(): f for f in latest.fields}
    dropped = [f.name for n, f in old.items() if n not in new]
    if dropped:
        raise SchemaChange(f"columns dropped since the previous result: {dropped}")
    retyped = [
        f"{f.name} ({old[n].dataType.simpleString()} -> {f.dataType.simpleString()})"
        for n, f in new.items()
        if n in old and old[n].dataType.simpleString() != f.dataType.simpleString()
    ]
    if retyped:
        raise SchemaChange(f"columns retyped since the previous result: {retyped}")
    if previous.columns == latest.names:
        return previous
    return previous.select(
        *[
            F.col(quoted(old[n].name)).alias(f.name)
            if n in old
            else F.lit(None).cast(f.dataType).alias(f.name)
            for n, f in new.items()
        ]
    )


def comparable(value: Column, dtype: T.DataType) -> Column:
    """``value`` in a form that ``=`` and ``<=>`` accept: maps become sorted entry arrays."""
    if not _has_map(dtype):
        return value
    if isinstance(dtype, T.MapType):
        entries = F.map_entries(value)
        if _has_map(dtype.valueType):
            entries = F.transform(
                entries,
                lambda e: F.struct(
                    e["key"].alias("key"), comparable(e["value"], dtype.valueType).alias("value")
                ),
            )
        return F.sort_array(entries)
    if isinstance(dtype, T.ArrayType):
        return F.transform(value, lambda x: comparable(x, dtype.elementType))
    return F.when(
        value.isNotNull(),
        F.struct(*[comparable(value[f.name], f.dataType).alias(f.name) for f in dtype.fields]),
    )


def _has_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.MapType):
        return True
    if isinstance(dtype, T.ArrayType):
        return _has_map(dtype.elementType)
    return isinstance(dtype, T.StructType) and any(_has_map(f.dataType) for f in dtype.fields)


def quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def side(alias: str, name: str) -> Column:
    return F.col(f"{alias}.{quoted(name)}")


def _row(alias: str, fields: Sequence[T.StructField]) -> Column:
    return F.struct(*[comparable(side(alias, f.name), f.dataType).alias(f.name) for f in fields])


def _packed(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    # The key columns stay bare so that a table bucketed on them joins without a shuffle.
    key_columns = [F.col(quoted(k)) for k in key_list(df, keys)]
    return df.select(*key_columns, F.struct(*[F.col(quoted(c)) for c in df.columns]).alias(name))


def any_null(keys: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.col(quoted(k)).isNull() for k in keys])

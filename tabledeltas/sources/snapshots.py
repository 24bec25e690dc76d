"""Saved results of one query, and the manifest that says which of them count.

A snapshot is a parquet directory clustered into hash buckets of the key. Two snapshots with
the same number of buckets are compared, and their keys checked, without a shuffle: the one
shuffle happens when the snapshot is written.

The manifest is an append-only dataset. An attempt at a run moves through its states in one
direction, so the state that counts is the furthest one of the last attempt. Every append is a
single small file.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledeltas.operators.changes import key_list
from tabledeltas.operators.latest import fold_latest
from tabledeltas.sources import files
from tabledeltas.sources.bucketed import default_buckets, read_bucketed, to_buckets, write_bucketed
from tabledeltas.sources.layout import GOLD, Layout

STAGED, REJECTED, COMMITTED, RETIRED = "staged", "rejected", "committed", "retired"
LIFECYCLE = (STAGED, REJECTED, COMMITTED, RETIRED)

MANIFEST_SCHEMA = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("run_ts", T.TimestampType()),
        T.StructField("path", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("key", T.ArrayType(T.StringType())),
        T.StructField("buckets", T.IntegerType()),
        T.StructField("schema", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("written_at", T.TimestampType()),
        T.StructField("attempt", T.IntegerType()),
    ]
)


@dataclass(frozen=True)
class SnapshotStore:
    """The snapshots of the query called ``query``; other queries are not seen."""

    layout: Layout
    query: str

    @property
    def manifest_path(self) -> str:
        return self.layout.of(GOLD, self.query).manifest

    @property
    def unclustered(self) -> str:
        return self.layout.of(GOLD, self.query).unclustered

    def unclustered_path(self, run_ts: datetime) -> str:
        """Where a result lies until its size and its key are known."""
        return f"{self.unclustered}/{snapshot_name(run_ts)}"

    @property
    def data_path(self) -> str:
        return self.layout.of(GOLD, self.query).rows

    def snapshot_path(self, run_ts: datetime) -> str:
        return f"{self.data_path}/{snapshot_name(run_ts)}"


@dataclass(frozen=True)
class Snapshot:
    """One saved run: where it is, and how it is clustered."""

    run_ts: datetime
    path: str
    rows: int
    key: tuple[str, ...]
    buckets: int
    schema: str  # JSON; a result without rows may have no file to read it from
    attempt: int = 0  # a rejected run may be tried again under its time


def snapshot_name(run_ts: datetime) -> str:
    """Fixed width, in UTC, so that names sort by time."""
    return "run_ts=" + as_utc(run_ts).strftime("%Y%m%dT%H%M%S.%fZ")


def as_utc(run_ts: datetime) -> datetime:
    """Aware UTC time. A naive one is local, as ``collect()`` returns timestamps."""
    return run_ts.astimezone(timezone.utc)


# --- manifest -----------------------------------------------------------------------------


def mark(spark: SparkSession, store: SnapshotStore, snapshots: Sequence[Snapshot], status: str) -> None:
    """Append the state of some runs as one file."""
    if status not in LIFECYCLE:
        raise ValueError(f"status must be one of {LIFECYCLE}, not {status!r}")
    now = datetime.now(timezone.utc)
    rows = [
        (store.query, s.run_ts, s.path, s.rows, list(s.key), s.buckets, s.schema, status, now, s.attempt)
        for s in snapshots
    ]
    if rows:
        files.append_rows(spark, rows, MANIFEST_SCHEMA, store.manifest_path)


def manifest(spark: SparkSession, store: SnapshotStore) -> DataFrame:
    """The state that counts for each run: one row per ``run_ts``."""
    if not files.exists(spark, store.manifest_path):
        return spark.createDataFrame([], MANIFEST_SCHEMA)
    log = spark.read.schema(MANIFEST_SCHEMA).parquet(store.manifest_path)
    step = F.array_position(F.array(*[F.lit(s) for s in LIFECYCLE]), F.col("status"))
    attempt = F.coalesce("attempt", F.lit(0)).alias("attempt")
    entry = F.struct("path", "rows", "key", "buckets", "schema", "status", "written_at", attempt)
    folded = fold_latest(
        log.select(
            "query", "run_ts", entry.alias("entry"), attempt, step.alias("step"), "written_at"
        ),
        keys={"query": "query", "run_ts": "run_ts"},
        value="entry",
        order_by=["attempt", "step", "written_at"],
    )
    return folded.select("query", "run_ts", "value.*")


@dataclass(frozen=True)
class StoreState:
    """Where the runs of a query stand."""

    committed: tuple[Snapshot, ...]  # not retired yet, oldest first
    last: datetime | None  # newest run that was not rejected
    staged: tuple[Snapshot, ...]  # saved but not committed; a crash leaves at most one
    refused: tuple[Snapshot, ...] = ()  # rejected since the newest commit

    @property
    def prior(self) -> Snapshot | None:
        """The newest committed run: what the next one is compared with."""
        return self.committed[-1] if self.committed else None


def store_state(spark: SparkSession, store: SnapshotStore) -> StoreState:
    entry = F.struct("run_ts", "path", "rows", "key", "buckets", "schema", "attempt")

    def only(status: str, what: str | Column) -> Column:
        return F.when(F.col("status") == status, F.col(what) if isinstance(what, str) else what)

    states = manifest(spark, store)
    row = states.agg(
        # bounded by what is kept and the runs since results were last retired
        F.sort_array(F.collect_list(only(COMMITTED, entry))).alias("committed"),
        F.max(F.when(F.col("status") != REJECTED, F.col("run_ts"))).alias("last"),
        F.sort_array(F.collect_list(only(STAGED, entry))).alias("staged"),
        F.max(only(REJECTED, "run_ts")).alias("refused"),
    ).first()
    committed = tuple(_snapshot(r) for r in row["committed"])
    prior, refused = committed[-1] if committed else None, []
    # An older run can no longer be tried again, so what is read does not grow with the query's age.
    if row["refused"] is not None and (prior is None or as_utc(row["refused"]) > prior.run_ts):
        since = F.lit(True) if prior is None else F.col("run_ts") > F.lit(prior.run_ts)
        refused = states.where((F.col("status") == REJECTED) & since).select(entry.alias("e")).collect()
    return StoreState(
        committed,
        as_utc(row["last"]) if row["last"] is not None else None,
        tuple(_snapshot(r) for r in row["staged"]),
        tuple(_snapshot(r["e"]) for r in refused),
    )


def latest_snapshot(spark: SparkSession, store: SnapshotStore) -> Snapshot | None:
    """The newest committed run: the prior result of the next one."""
    return store_state(spark, store).prior


def _snapshot(row) -> Snapshot:
    return Snapshot(
        as_utc(row["run_ts"]),
        row["path"],
        row["rows"],
        tuple(row["key"]),
        row["buckets"],
        row["schema"],
        row["attempt"] or 0,
    )


def reject_staged(spark: SparkSession, store: SnapshotStore) -> list[Snapshot]:
    """Give up runs that were saved but cannot be finished, e.g. because the sink never takes
    their changes. What a sink has of them already stays there."""
    staged = list(store_state(spark, store).staged)
    mark(spark, store, staged, REJECTED)
    return staged


# --- data ---------------------------------------------------------------------------------


def write_snapshot(
    df: DataFrame,
    pk: str | Sequence[str],
    path: str,
    run_ts: datetime,
    buckets: int | None = None,
) -> Snapshot:
    """Save a result once, one file per hash bucket of its key.

    Fails if the path already holds data. Unique keys spread evenly over the buckets; check
    the key first, for a repeated one fills one task. Rows are not counted here.
    """
    keys = key_list(df, pk)
    buckets = buckets or default_buckets(df.sparkSession)
    write_bucketed(to_buckets(df, keys, buckets), keys, path, buckets)
    return Snapshot(as_utc(run_ts), path, 0, tuple(keys), buckets, df.schema.json())


def load_snapshot(spark: SparkSession, snapshot: Snapshot) -> DataFrame:
    """Read a saved result so that Spark knows its bucketing."""
    return read_bucketed(spark, snapshot.key, snapshot.path, snapshot.buckets, snapshot.schema)


def retire_snapshots(
    spark: SparkSession,
    store: SnapshotStore,
    keep: int = 2,
    committed: Sequence[Snapshot] | None = None,
) -> list[Snapshot]:
    """Keep the ``keep`` newest committed runs; mark the others retired and drop their data.

    Every other directory older than the newest commit goes too: what a crash left behind
    half-written or marked but not dropped, and rejected runs. ``committed`` are the committed
    runs where the caller knows them.
    """
    if keep < 1:
        raise ValueError("at least the newest snapshot must be kept")
    known = store_state(spark, store).committed if committed is None else committed
    runs = sorted(known, key=lambda s: s.run_ts, reverse=True)
    kept, retired = runs[:keep], runs[keep:]
    if not kept:
        return []
    mark(spark, store, retired, RETIRED)
    names_kept = {snapshot_name(s.run_ts) for s in kept}
    newest = snapshot_name(kept[0].run_ts)
    for name in files.child_directories(spark, store.data_path):
        if name < newest and name not in names_kept:
            files.delete(spark, f"{store.data_path}/{name}")
    for name in files.child_directories(spark, store.unclustered):
        if name <= newest:
            files.delete(spark, f"{store.unclustered}/{name}")
    return retired

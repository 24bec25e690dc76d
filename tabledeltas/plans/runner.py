"""The incremental query runner: run any SQL, save its result, emit what changed.

    finish a run that was saved but not committed
    plan the comparison; refuse what cannot be compared
    run the SQL, save its result once, observed         -> unclustered; rejected, if keys are null
    cluster it by the key, in buckets made for its size
    check the key of the clustered result               -> rejected, if it is none; else staged
    compare it with the prior saved result, emit        -> sink
    commit, retire older results                        -> committed, retired

Changes are derived from saved results only, so what is emitted always agrees with what is
kept, however often the tables move or the run is repeated. Emitting is at least once under
a fixed ``run_ts``.

While the result is saved, Spark observes its rows, its null keys and, in a sketch, how many
rows share a key. Clustering then neither meets rows without a key nor a key that would fill a
task: if the sketch leaves that possible, keys are counted first, within each task before the
shuffle. Whether the key is one is decided on the clustered result, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tabledeltas.operators.changes import (
    KeyViolation,
    any_null,
    change_feed,
    key_list,
    key_stats,
    quoted,
)
from tabledeltas.sources import files
from tabledeltas.sources.bucketed import BYTES_PER_BUCKET, default_buckets, enough_buckets
from tabledeltas.sources.sinks import Sink, emit_changes
from tabledeltas.sources.snapshots import (
    COMMITTED,
    REJECTED,
    STAGED,
    Snapshot,
    SnapshotStore,
    StoreState,
    as_utc,
    load_snapshot,
    mark,
    retire_snapshots,
    store_state,
    write_snapshot,
)


#: Keys that the sketch of a result tracks, and rows of a key that no task minds.
TRACKED, FEW = 10_000, 100_000


class SqlFailure(ValueError):
    """Spark could not parse or resolve the query."""


@dataclass(frozen=True)
class Run:
    """A committed run. ``feed`` is derived from the saved results when it is used."""

    run_ts: datetime
    snapshot: Snapshot
    feed: DataFrame
    finished: tuple[Snapshot, ...]


def query_result(
    spark: SparkSession, sql: str, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """Any SQL over the session's views and ``tables``."""
    for name, table in (tables or {}).items():
        table.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    except AnalysisException as e:
        raise SqlFailure(str(e)) from e


def run_query(
    spark: SparkSession,
    sql: str,
    pk: str | Sequence[str],
    tables: Mapping[str, DataFrame],
    store: SnapshotStore,
    sink: Sink,
    run_ts: datetime | None = None,
    keep: int = 2,
    null_safe: bool = True,
    buckets: int | None = None,
    bytes_per_bucket: int = BYTES_PER_BUCKET,
) -> Run:
    """One run of the query named by ``store``; only one may be under way at a time.

    ``buckets`` sets how many files the saved result is clustered into. By default it is
    that of the prior result, so that the two are compared without a shuffle, doubled until
    a bucket of this result holds ``bytes_per_bucket`` at most; the first time it starts from
    the session's number of shuffle partitions. A limit of Spark's that is too low for it is
    an error.

    ``keep`` results are kept, two at least: the feed handed out is read from the last two.
    The time of a rejected run may be used again.
    """
    state = store_state(spark, store)
    prior = state.prior
    # Finished from its own saved result and under its own run_ts: evaluating again could
    # lose deletes of keys that were already emitted.
    for staged in state.staged:
        _finish(spark, store, prior, staged, sink, null_safe)
        prior = staged

    last = max([t for t in (state.last, *(s.run_ts for s in state.staged)) if t], default=None)
    run_ts = _checked_time(run_ts, last, state)
    result = query_result(spark, sql, tables)
    keys = tuple(key_list(result, pk))
    if prior is not None:
        if [k.lower() for k in keys] != [k.lower() for k in prior.key]:
            raise ValueError(f"the key changed from {prior.key} to {keys}: use a new query name")
    before = result.where(F.lit(False)) if prior is None else load_snapshot(spark, prior)
    _check_comparison(before, result, keys, null_safe)  # schemas only; fails before any work
    attempt = max([s.attempt + 1 for s in state.refused if s.run_ts == run_ts], default=0)

    path, raw = store.snapshot_path(run_ts), store.unclustered_path(run_ts)
    for left in (path, raw):  # of an earlier attempt at this time
        files.delete(spark, left)
    rows, nulls, most = _save(result, keys, raw)
    once = spark.read.schema(result.schema).parquet(raw)
    if buckets is None:
        first = default_buckets(spark) if prior is None else prior.buckets
        buckets = enough_buckets(spark, first, [raw], bytes_per_bucket)
    repeated = 0
    if not nulls and most * buckets > rows and most > FEW:
        _, _, repeated = key_stats(once, keys)
    saved = Snapshot(run_ts, path, rows, keys, buckets, result.schema.json(), attempt)
    if not nulls and not repeated:
        saved = replace(
            write_snapshot(once, keys, path, run_ts, buckets), rows=rows, attempt=attempt
        )
        _, _, repeated = key_stats(load_snapshot(spark, saved), keys)
    files.delete(spark, raw)
    if nulls or repeated:
        mark(spark, store, [saved], REJECTED)
        files.delete(spark, path)
        raise KeyViolation(
            f"run rejected, {list(keys)} is not a key of its result: "
            f"{nulls} rows with a null key, {repeated} repeated keys"
        )
    mark(spark, store, [saved], STAGED)
    feed = _finish(spark, store, prior, saved, sink, null_safe)
    retire_snapshots(spark, store, max(2, keep), [*state.committed, *state.staged, saved])
    return Run(run_ts, saved, feed, state.staged)


def _save(result: DataFrame, keys: Sequence[str], path: str) -> tuple[int, int, int]:
    """Write a result; its rows, those with a null key, and a bound of the rows of any key."""
    observed = Observation()
    key = F.xxhash64(*[F.col(quoted(k)) for k in keys])
    result.observe(
        observed,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_null(keys)).alias("nulls"),
        _most_frequent(key).alias("most"),
    ).write.parquet(path)
    found = observed.get
    return found["rows"], found["nulls"], found["most"][0]["count"] if found["most"] else 0


def _most_frequent(value: Column) -> Column:
    return F.call_function("approx_top_k", value, F.lit(1), F.lit(TRACKED))


def changes_between(
    spark: SparkSession, previous: Snapshot | None, latest: Snapshot, null_safe: bool = True
) -> DataFrame:
    """The change feed of two saved results; without a previous one every row is an insert."""
    after = load_snapshot(spark, latest)
    if previous is None:
        before = after.where(F.lit(False))
    else:
        before = load_snapshot(spark, previous)
    return change_feed(before, after, latest.key, null_safe, latest.run_ts)


def _check_comparison(
    before: DataFrame, result: DataFrame, keys: Sequence[str], null_safe: bool
) -> None:
    try:
        change_feed(before, result, keys, null_safe).schema  # resolves the plan, runs nothing
    except AnalysisException as e:
        raise ValueError(f"results of this query cannot be compared: {e}") from e


def _finish(
    spark: SparkSession,
    store: SnapshotStore,
    prior: Snapshot | None,
    staged: Snapshot,
    sink: Sink,
    null_safe: bool,
) -> DataFrame:
    feed = changes_between(spark, prior, staged, null_safe)
    emit_changes(feed, staged.key, sink, staged.run_ts)
    mark(spark, store, [staged], COMMITTED)
    return feed


def _checked_time(
    run_ts: datetime | None, last: datetime | None, state: StoreState
) -> datetime:
    """The prior result is the newest by run time, so run times must grow."""
    if run_ts is None:
        now = datetime.now(timezone.utc)
        times = [last, *(s.run_ts for s in state.refused)]
        return max([now, *(t + timedelta(microseconds=1) for t in times if t is not None)])
    run_ts = as_utc(run_ts)
    if last is not None and run_ts <= last:
        raise ValueError(f"run_ts {run_ts} is not after the last run's {last}")
    return run_ts

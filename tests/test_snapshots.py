from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from plan_text import count_of
from tabledeltas.operators import change_feed
from tabledeltas.operators.changes import key_stats
from tabledeltas.sources import files
from tabledeltas.sources import (
    Layout,
    SnapshotStore,
    latest_snapshot,
    load_snapshot,
    retire_snapshots,
    write_snapshot,
)
from tabledeltas.sources.snapshots import (
    COMMITTED,
    REJECTED,
    RETIRED,
    STAGED,
    manifest,
    mark,
    snapshot_name,
    store_state,
)

T0 = datetime(2024, 1, 1, 10, tzinfo=timezone.utc)


@pytest.fixture
def store(lake):
    return SnapshotStore(lake, "q")


def save(spark, store, run_ts, rows=100, statuses=(STAGED, COMMITTED), buckets=4):
    path = store.snapshot_path(run_ts)
    df = spark.range(rows).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    snapshot = replace(write_snapshot(df, "k", path, run_ts, buckets), rows=rows)
    for status in statuses:
        mark(spark, store, [snapshot], status)
    return snapshot


def states(spark, store):
    return [r["status"] for r in manifest(spark, store).orderBy("run_ts").collect()]


def test_paths():
    layout = Layout("s3a://bucket/lake/")
    assert layout.of("bronze", "xx").rows == "s3a://bucket/lake/bronze/xx/rows"
    assert layout.of("silver", "yy").progress == "s3a://bucket/lake/silver/yy/progress"
    assert layout.of("gold", "q").manifest == "s3a://bucket/lake/gold/q/manifest"
    with pytest.raises(ValueError, match="platinum"):
        layout.of("platinum", "xx")


def test_names_sort_by_time():
    """Also on the full second, where shortened text would not, and across time zones."""
    times = [T0, T0 + timedelta(microseconds=1), T0 + timedelta(seconds=1), T0 + timedelta(days=300)]
    names = [snapshot_name(t) for t in times]
    assert names == sorted(names) and len({len(n) for n in names}) == 1
    elsewhere = T0.astimezone(timezone(timedelta(hours=5)))
    assert snapshot_name(elsewhere) == snapshot_name(T0)


def test_saved_result_reads_back(spark, store):
    snapshot = save(spark, store, T0)
    assert load_snapshot(spark, snapshot).agg(F.count("k"), F.sum("v")).first() == (100, 9900)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tabledeltas_")]


def test_path_that_holds_data_is_not_overwritten(spark, store):
    save(spark, store, T0)
    with pytest.raises(Exception, match="(?i)non-empty|exists"):
        save(spark, store, T0, rows=1)
    assert load_snapshot(spark, latest_snapshot(spark, store)).count() == 100


def test_saved_results_are_compared_and_checked_without_a_shuffle(spark, store):
    first, second = save(spark, store, T0), save(spark, store, T0 + timedelta(1), rows=150)
    feed = change_feed(load_snapshot(spark, first), load_snapshot(spark, second), "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert count_of(feed, "Exchange") == 0
        per_key = load_snapshot(spark, second).groupBy("k").count()
        assert count_of(per_key, "Exchange") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dict(feed.groupBy("op").count().collect()) == {"I": 50}
    assert key_stats(load_snapshot(spark, second), "k") == (150, 0, 0)


def test_other_bucket_count_still_compares_right(spark, store):
    first = save(spark, store, T0, buckets=3)
    second = save(spark, store, T0 + timedelta(1), rows=150, buckets=7)
    feed = change_feed(load_snapshot(spark, first), load_snapshot(spark, second), "k")
    assert dict(feed.groupBy("op").count().collect()) == {"I": 50}


def test_nested_columns_and_odd_names_survive(spark, store):
    df = spark.sql(
        "SELECT 1 AS `user id`, named_struct('a b', 1, 'c', array(map('x', 1))) AS s, "
        "CAST(NULL AS DECIMAL(10,2)) AS d, timestamp'2024-01-01 00:00:00' AS t"
    )
    path = store.snapshot_path(T0)
    loaded = load_snapshot(spark, write_snapshot(df, "user id", path, T0, 2))
    assert loaded.collect() == df.collect()
    assert change_feed(df, loaded, "user id").count() == 0


def test_latest_is_the_newest_committed_run(spark, store):
    assert latest_snapshot(spark, store) is None
    save(spark, store, T0)
    second = save(spark, store, T0 + timedelta(seconds=1))
    save(spark, store, T0 + timedelta(seconds=2), statuses=[STAGED])
    save(spark, store, T0 + timedelta(seconds=3), statuses=[REJECTED])
    assert latest_snapshot(spark, store) == second
    state = store_state(spark, store)
    assert [s.run_ts for s in state.staged] == [T0 + timedelta(seconds=2)]
    assert state.last == T0 + timedelta(seconds=2)  # the time of a rejected run is free
    assert [s.run_ts for s in state.refused] == [T0 + timedelta(seconds=3)]


def test_state_moves_one_way_even_if_written_again(spark, store):
    snapshot = save(spark, store, T0)
    mark(spark, store, [snapshot], STAGED)
    assert states(spark, store) == [COMMITTED]


def test_queries_do_not_see_each_other(spark, store):
    save(spark, store, T0)
    assert latest_snapshot(spark, SnapshotStore(store.layout, "other")) is None


def test_retire_keeps_the_newest(spark, store):
    saved = [save(spark, store, T0 + timedelta(i)) for i in range(4)]
    assert retire_snapshots(spark, store, keep=2) == [saved[1], saved[0]]
    assert states(spark, store) == [RETIRED, RETIRED, COMMITTED, COMMITTED]
    assert [files.exists(spark, s.path) for s in saved] == [False, False, True, True]
    assert retire_snapshots(spark, store, keep=2) == []
    with pytest.raises(ValueError):
        retire_snapshots(spark, store, keep=0)


def test_retire_drops_what_a_crash_or_a_rejection_left(spark, store):
    half_written = store.snapshot_path(T0 - timedelta(1))
    spark.range(3).write.parquet(half_written)
    marked = save(spark, store, T0, statuses=[STAGED, COMMITTED, RETIRED])
    refused = save(spark, store, T0 + timedelta(1), statuses=[REJECTED])
    kept = [save(spark, store, T0 + timedelta(i)) for i in (2, 3)]
    under_way = save(spark, store, T0 + timedelta(4), statuses=[STAGED])
    retire_snapshots(spark, store)
    assert not files.exists(spark, half_written)
    assert [files.exists(spark, s.path) for s in (marked, refused, *kept, under_way)] == [
        False,
        False,
        True,
        True,
        True,
    ]


def test_working_folders_are_shared(spark):
    with pytest.raises(files.NotSharedError, match="spark.checkpoint.dir"):
        files.assert_shared("file:/warehouse/_working", "spark://host:7077")
    files.assert_shared("hdfs://host/warehouse/_working", "yarn")
    files.assert_shared("file:/warehouse/_working", "local[8]")

    made = files.scratch_directory(spark)
    assert made.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert files.exists(spark, made)

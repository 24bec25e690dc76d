from datetime import datetime, timedelta, timezone

import pytest

import tabledeltas.plans.runner as runner
from tabledeltas.operators import KeyViolation, SchemaChange, apply_changes
from tabledeltas.plans import SqlFailure, query_result, run_query
from tabledeltas.sources import SnapshotStore, file_sink, files, load_snapshot, reject_staged
from tabledeltas.sources.snapshots import manifest, snapshot_name, store_state

SQL = "SELECT k, v FROM t"
T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


class Harness:
    """Runs one query over a table of ``(k, v)`` and reads what was sent."""

    def __init__(self, spark, lake):
        self.spark, self.store = spark, SnapshotStore(lake, "q")
        self.out = f"{lake.base}/out"
        self.sink = file_sink(self.out, "json")

    def table(self, rows):
        return self.spark.createDataFrame(rows, "k string, v int")

    def run(self, rows, **options):
        options.setdefault("sink", self.sink)
        return run_query(self.spark, SQL, "k", {"t": self.table(rows)}, store=self.store, **options)

    def sent(self, run_ts):
        df = self.spark.read.schema("key string, value string").json(f"{self.out}/{snapshot_name(run_ts)}")
        return sorted(map(tuple, df.collect()))

    def states(self):
        return [r["status"] for r in manifest(self.spark, self.store).orderBy("run_ts").collect()]


@pytest.fixture
def q(spark, lake):
    return Harness(spark, lake)


def upsert(k, v):
    return (f'{{"k":"{k}"}}', f'{{"k":"{k}","v":{"null" if v is None else v}}}')


def delete(k):
    return (f'{{"k":"{k}"}}', None)


def test_three_runs(q):
    first = q.run([("a", 1), ("b", 2), ("c", None)])
    assert q.sent(first.run_ts) == [upsert("a", 1), upsert("b", 2), upsert("c", None)]
    second = q.run([("a", 1), ("b", None), ("d", 4)])
    assert q.sent(second.run_ts) == [upsert("b", None), delete("c"), upsert("d", 4)]
    assert {r["op"] for r in second.feed.collect()} == {"I", "U", "D"}
    third = q.run([("a", 1), ("b", None), ("d", 4)])
    assert q.sent(third.run_ts) == []
    assert q.states() == ["retired", "committed", "committed"]
    assert [s for s in files.child_directories(q.spark, q.store.data_path)] == [
        snapshot_name(second.run_ts),
        snapshot_name(third.run_ts),
    ]


def test_feed_leads_from_the_prior_result_to_the_saved_one(q):
    first = q.run([("a", 1), ("b", 2)])
    second = q.run([("b", 3), ("c", 4)])
    applied = apply_changes(load_snapshot(q.spark, first.snapshot), second.feed, "k")
    assert sorted(map(tuple, applied.collect())) == [("b", 3), ("c", 4)]


def test_empty_results(q):
    assert q.sent(q.run([]).run_ts) == []
    assert q.sent(q.run([("a", 1)]).run_ts) == [upsert("a", 1)]
    assert q.sent(q.run([]).run_ts) == [delete("a")]


def test_plain_equality_as_an_option(q):
    q.run([("a", 1), ("b", 1)], null_safe=False)
    assert q.sent(q.run([("a", None), ("b", 2)], null_safe=False).run_ts) == [upsert("b", 2)]


def test_composite_key_and_bucket_count_carry_over(spark, q):
    def run(rows, **options):
        table = spark.createDataFrame(rows, "a int, b string, v int")
        sql = "SELECT * FROM t2"
        return run_query(spark, sql, ["a", "b"], {"t2": table}, q.store, q.sink, **options)

    first = run([(1, "x", 1), (1, "y", 1)], buckets=3)
    second = run([(1, "x", 2), (1, "y", 1)])
    assert (first.snapshot.buckets, second.snapshot.buckets) == (3, 3)
    assert q.sent(second.run_ts) == [('{"a":1,"b":"x"}', '{"a":1,"b":"x","v":2}')]
    with pytest.raises(ValueError, match="key changed"):
        run_query(spark, "SELECT * FROM t2", "a", {}, q.store, q.sink)


def test_buckets_grow_with_the_result(q):
    first = q.run([("a", 1), ("b", 2)], buckets=2)
    few = files.size(q.spark, first.snapshot.path) // 4
    second = q.run([("a", 1), ("c", 2)], bytes_per_bucket=few)
    assert second.snapshot.buckets >= 4
    assert q.sent(second.run_ts) == [delete("b"), upsert("c", 2)]
    assert q.sent(q.run([("c", 2)], buckets=5).run_ts) == [delete("a")]


def test_first_result_and_a_jump_are_sized_by_themselves(q):
    """The size of the result itself counts, not that of the one before it."""
    first = q.run([(f"k{i}", i) for i in range(4000)], bytes_per_bucket=4000)
    assert first.snapshot.buckets >= 8 and first.snapshot.rows == 4000
    second = q.run([(f"k{i}", i) for i in range(40_000)], bytes_per_bucket=4000)
    assert second.snapshot.buckets >= 4 * first.snapshot.buckets
    assert len(q.sent(second.run_ts)) == 36_000


def test_too_few_buckets_is_an_error(q):
    q.spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "8")
    try:
        with pytest.raises(ValueError, match="maxBuckets is 8"):
            q.run([(f"k{i}", i) for i in range(4000)], bytes_per_bucket=100)
    finally:
        q.spark.conf.unset("spark.sql.sources.bucketing.maxBuckets")
    assert q.run([("a", 1)]).finished == ()


# --- refusals -----------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [[("a", 1), ("a", 2)], [(None, 1), ("a", 2)]])
def test_result_without_a_key_is_rejected_and_not_picked_up_again(q, rows):
    q.run([("a", 1)], run_ts=T0)
    with pytest.raises(KeyViolation):
        q.run(rows, run_ts=T0 + timedelta(1))
    assert q.states() == ["committed", "rejected"]
    third = q.run([("a", 3)], run_ts=T0 + timedelta(2))
    assert third.finished == ()
    assert q.sent(third.run_ts) == [upsert("a", 3)]


def test_null_keys_are_rejected_before_they_meet_in_a_task(q, monkeypatch):
    monkeypatch.setattr(runner, "write_snapshot", crash)  # the only step that deals by key
    with pytest.raises(KeyViolation, match="100 rows with a null key"):
        q.run([(None if i % 3 == 0 else f"k{i}", i) for i in range(300)])


def test_a_key_that_fills_a_task_is_found_before_clustering(q, monkeypatch):
    """The sketch sees that a third of the rows may share a key; few rows of a key are found in
    the clustered result."""
    rows = [(f"k{0 if i % 3 == 0 else i}", i) for i in range(300)]
    with pytest.raises(KeyViolation, match="1 repeated keys"):
        q.run(rows)
    assert files.child_directories(q.spark, q.store.data_path) == []
    monkeypatch.setattr(runner, "FEW", 0)
    monkeypatch.setattr(runner, "write_snapshot", crash)
    with pytest.raises(KeyViolation, match="1 repeated keys"):
        q.run(rows)
    assert files.child_directories(q.spark, q.store.unclustered) == []


def test_time_of_a_rejected_run_can_be_used_again(q):
    q.run([("a", 1)], run_ts=T0)
    for _ in range(2):
        with pytest.raises(KeyViolation):
            q.run([("a", 1), ("a", 2)], run_ts=T0 + timedelta(1))
    again = q.run([("a", 2)], run_ts=T0 + timedelta(1))
    assert q.states() == ["committed", "committed"]
    assert q.sent(again.run_ts) == [upsert("a", 2)]


def test_what_cannot_be_compared_is_refused_before_any_work(spark, q):
    q.run([("a", 1)])
    variant = "SELECT k, v, parse_json('{}') AS w FROM t"
    with pytest.raises(ValueError, match="cannot be compared"):
        run_query(spark, variant, "k", {}, q.store, q.sink)
    fresh = SnapshotStore(q.store.layout, "q2")
    with pytest.raises(ValueError, match="must not be named"):
        run_query(spark, "SELECT k AS op, v FROM t", "op", {}, fresh, q.sink)
    with pytest.raises(ValueError, match="cannot be compared"):
        run_query(spark, variant, "k", {}, fresh, q.sink)
    assert q.states() == ["committed"]
    assert q.sent(q.run([("a", 2)]).run_ts) == [upsert("a", 2)]


def test_staged_run_that_cannot_be_finished_can_be_given_up(q):
    q.run([("a", 1)], run_ts=T0)
    with pytest.raises(Crash):
        q.run([("b", 1)], run_ts=T0 + timedelta(1), sink=crash)
    assert [s.run_ts for s in reject_staged(q.spark, q.store)] == [T0 + timedelta(1)]
    third = q.run([("a", 2)], run_ts=T0 + timedelta(1))
    assert third.finished == ()
    assert q.sent(third.run_ts) == [upsert("a", 2)]


def test_feed_can_be_read_whatever_is_kept(q):
    q.run([("a", 1)], keep=1)
    run = q.run([("a", 2)], keep=1)
    assert [r["op"] for r in run.feed.collect()] == ["U"]


def test_dropped_column_fails_before_anything_is_saved(spark, q):
    q.run([("a", 1)])
    with pytest.raises(SchemaChange, match="v"):
        run_query(spark, "SELECT k FROM t", "k", {}, q.store, q.sink)
    assert q.states() == ["committed"]
    assert len(files.child_directories(spark, q.store.data_path)) == 1


def test_added_column_is_compared_as_null(spark, q):
    q.run([("a", 1), ("b", 1)])
    sql = "SELECT k, v, CASE WHEN k = 'a' THEN 7 END AS w FROM t"
    run = run_query(spark, sql, "k", {}, q.store, q.sink)
    assert q.sent(run.run_ts) == [('{"k":"a"}', '{"k":"a","v":1,"w":7}')]


@pytest.mark.parametrize("sql", ["SELEC 1", "SELECT nothing FROM t", "SELECT * FROM no_such_table"])
def test_sql_errors_are_their_own(spark, q, sql):
    with pytest.raises(SqlFailure):
        query_result(spark, sql, {"t": q.table([("a", 1)])})


def test_missing_key_column(q):
    with pytest.raises(ValueError, match="nope"):
        run_query(q.spark, SQL, "nope", {"t": q.table([("a", 1)])}, q.store, q.sink)


def test_run_times_must_grow(q):
    q.run([("a", 1)], run_ts=T0)
    with pytest.raises(ValueError, match="not after"):
        q.run([("a", 1)], run_ts=T0)
    ahead = q.run([("a", 2)], run_ts=datetime.now(timezone.utc) + timedelta(days=1))
    assert q.run([("a", 3)]).run_ts == ahead.run_ts + timedelta(microseconds=1)


# --- crashes ------------------------------------------------------------------------------


class Crash(Exception):
    pass


def crash(*_args, **_kwargs):
    raise Crash


def test_crash_while_saving_leaves_nothing_that_counts(q, monkeypatch):
    q.run([("a", 1)], run_ts=T0)
    real = runner.write_snapshot

    def half(*args):
        real(*args)
        raise Crash

    with monkeypatch.context() as m:
        m.setattr(runner, "write_snapshot", half)
        with pytest.raises(Crash):
            q.run([("b", 1)], run_ts=T0 + timedelta(1))
    assert q.states() == ["committed"]
    third = q.run([("a", 1), ("c", 1)], run_ts=T0 + timedelta(2))
    assert third.finished == ()
    assert q.sent(third.run_ts) == [upsert("c", 1)]
    # What the crash left goes with the next results that are retired.
    assert len(files.child_directories(q.spark, q.store.data_path)) == 2


def test_result_that_a_crash_left_unclustered_is_dropped(q, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(runner, "write_snapshot", crash)
        with pytest.raises(Crash):
            q.run([("a", 1)], run_ts=T0)
    assert files.child_directories(q.spark, q.store.unclustered) == [snapshot_name(T0)]
    q.run([("a", 1)], run_ts=T0 + timedelta(1))
    assert files.child_directories(q.spark, q.store.unclustered) == []


def test_rejected_runs_before_the_newest_commit_are_not_read_again(q):
    for n in range(3):
        with pytest.raises(KeyViolation):
            q.run([("a", 1), ("a", 2)], run_ts=T0 + timedelta(n))
    assert len(store_state(q.spark, q.store).refused) == 3
    q.run([("a", 1)], run_ts=T0 + timedelta(3))
    assert store_state(q.spark, q.store).refused == ()
    with pytest.raises(KeyViolation):
        q.run([("a", 1), ("a", 2)], run_ts=T0 + timedelta(4))
    assert [s.run_ts for s in store_state(q.spark, q.store).refused] == [T0 + timedelta(4)]


@pytest.mark.parametrize("emitted", [False, True])
def test_crash_after_staging_is_finished_from_the_saved_result(q, monkeypatch, emitted):
    """Also when the tables moved in between: keys already sent get their deletes."""
    q.run([("a", 1)], run_ts=T0)

    def failing(messages, run_ts):
        if emitted:
            q.sink(messages, run_ts)
        raise Crash

    crashed_at = T0 + timedelta(1)
    with pytest.raises(Crash):
        q.run([("a", 1), ("b", 1)], run_ts=crashed_at, sink=failing)
    assert q.states() == ["committed", "staged"]

    third = q.run([("a", 2)], run_ts=T0 + timedelta(2))
    assert [s.run_ts for s in third.finished] == [crashed_at]
    assert q.sent(crashed_at) == [upsert("b", 1)]
    assert q.sent(third.run_ts) == [upsert("a", 2), delete("b")]
    assert q.states() == ["retired", "committed", "committed"]


def test_crash_before_the_commit_sends_the_same_again(q, monkeypatch):
    q.run([("a", 1)], run_ts=T0)
    real, sent = runner.mark, []

    def sink(messages, run_ts):
        sent.append((run_ts, sorted(map(tuple, messages.collect()))))

    def no_commit(spark, store, snapshots, status):
        if status == "committed":
            raise Crash
        real(spark, store, snapshots, status)

    with monkeypatch.context() as m:
        m.setattr(runner, "mark", no_commit)
        with pytest.raises(Crash):
            q.run([("b", 1)], run_ts=T0 + timedelta(1), sink=sink)
    q.run([("b", 1)], run_ts=T0 + timedelta(2), sink=sink)
    first, again, last = sent
    assert first == again == (T0 + timedelta(1), [delete("a"), upsert("b", 1)])
    assert last == (T0 + timedelta(2), [])


def test_crash_before_retiring(q, monkeypatch):
    q.run([("a", 1)])
    q.run([("a", 2)])
    with monkeypatch.context() as m:
        m.setattr(runner, "retire_snapshots", crash)
        with pytest.raises(Crash):
            q.run([("a", 3)])
    assert q.states() == ["committed"] * 3
    q.run([("a", 4)])
    assert q.states() == ["retired", "retired", "committed", "committed"]

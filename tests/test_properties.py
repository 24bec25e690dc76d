"""Laws that hold for any states and any changelog."""

from __future__ import annotations

from functools import reduce

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tabledeltas.operators import apply_changes, change_feed, fold_latest

few = settings(
    max_examples=12,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow],
)

STATE = "k int, v int, w string"
values = st.tuples(st.one_of(st.none(), st.integers(0, 2)), st.one_of(st.none(), st.sampled_from("ab")))
states = st.dictionaries(st.integers(0, 6), values, max_size=7)

LOG = "key struct<k: int>, value struct<v: int>, offset bigint"
logs = st.lists(st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(0, 9))), min_size=1, max_size=12)


def frame(spark, state):
    return spark.createDataFrame([(k, *v) for k, v in state.items()], STATE)


def as_dict(df):
    rows = df.collect()
    assert len(rows) == len({r["k"] for r in rows})
    return {r["k"]: (r["v"], r["w"]) for r in rows}


@few
@given(previous=states, latest=states)
def test_feed_laws(spark, previous, latest):
    before, after = frame(spark, previous), frame(spark, latest)
    feed = change_feed(before, after, "k")
    assert as_dict(apply_changes(before, feed, "k")) == latest
    ops = {r["k"]: r["op"] for r in feed.collect()}
    assert {k for k, op in ops.items() if op == "I"} == latest.keys() - previous.keys()
    assert {k for k, op in ops.items() if op == "D"} == previous.keys() - latest.keys()
    assert {k for k, op in ops.items() if op == "U"} == {
        k for k in previous.keys() & latest.keys() if previous[k] != latest[k]
    }


@few
@given(state=states)
def test_nothing_changes_from_a_state_to_itself(spark, state):
    assert change_feed(frame(spark, state), frame(spark, state), "k").count() == 0


def records(log):
    return [((k,), None if v is None else (v,), i) for i, (k, v) in enumerate(log)]


def folded(df, keys=None, order="offset"):
    rows = fold_latest(df, keys or {"k": "key.k"}, order_by=order).collect()
    return {r["k"]: (r["value"] and r["value"]["v"], r["ord"]) for r in rows}


def expected(log):
    return {k: (v, i) for i, (k, v) in enumerate(log)}


@few
@given(log=logs, seed=st.randoms(use_true_random=False), files=st.integers(1, 4))
def test_fold_does_not_depend_on_the_order_of_its_input(spark, log, seed, files):
    rows = records(log)
    seed.shuffle(rows)
    df = spark.createDataFrame(rows, LOG).repartition(files)
    assert folded(df) == expected(log)


@few
@given(log=logs, cuts=st.lists(st.integers(0, 12), max_size=3), replay=st.booleans())
def test_fold_of_folded_batches_is_the_fold_of_all(spark, log, cuts, replay):
    rows = records(log)
    edges = [0, *sorted(min(c, len(rows)) for c in cuts), len(rows)]
    batches = [rows[a:b] for a, b in zip(edges, edges[1:])]
    if replay:
        batches.append(batches[0])
    parts = [fold_latest(spark.createDataFrame(b, LOG), {"k": "key.k"}) for b in batches]
    assert folded(reduce(lambda a, b: a.union(b), parts), {"k": "k"}, "ord") == expected(log)

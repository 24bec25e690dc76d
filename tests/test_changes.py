import pytest
from pyspark.sql import functions as F

from tabledeltas.operators import (
    KeyViolation,
    SchemaChange,
    apply_changes,
    assert_key,
    change_feed,
    deletes,
    inserts,
    updates,
)

SCHEMA = "k string, v int, o int"
PREVIOUS = [("a", 1, None), ("b", 1, 5), ("c", 1, None), ("d", 1, 7), ("e", 1, None), ("g", 1, 1)]
LATEST = [("a", 1, 3), ("b", 1, None), ("c", 2, None), ("d", 1, 7), ("e", 1, None), ("f", 1, 1)]


@pytest.fixture(scope="module")
def states(spark):
    return spark.createDataFrame(PREVIOUS, SCHEMA), spark.createDataFrame(LATEST, SCHEMA)


def keys(df):
    return sorted(r["k"] for r in df.collect())


def ops(feed):
    return sorted((r["op"], r["k"]) for r in feed.collect())


def test_changes_to_and_from_null_are_updates(states):
    assert keys(updates(*states, "k")) == ["a", "b", "c"]


def test_plain_equality_misses_changes_to_and_from_null(states):
    assert keys(updates(*states, "k", null_safe=False)) == ["c"]


def test_inserts_and_deletes(states):
    assert keys(inserts(*states, "k")) == ["f"]
    assert keys(deletes(*states, "k")) == ["g"]


def test_updates_are_rows_of_the_latest_state(states):
    rows = {r["k"]: tuple(r) for r in updates(*states, "k").collect()}
    assert rows["a"] == ("a", 1, 3) and rows["b"] == ("b", 1, None)


@pytest.mark.parametrize("null_safe", [True, False])
def test_one_pass_equals_three_joins(states, null_safe):
    three = (
        [("I", k) for k in keys(inserts(*states, "k"))]
        + [("U", k) for k in keys(updates(*states, "k", null_safe))]
        + [("D", k) for k in keys(deletes(*states, "k"))]
    )
    assert ops(change_feed(*states, "k", null_safe)) == sorted(three)


def test_feed_carries_both_rows(states):
    rows = {r["k"]: r for r in change_feed(*states, "k").collect()}
    assert rows["f"]["before"] is None and tuple(rows["f"]["after"]) == ("f", 1, 1)
    assert tuple(rows["g"]["before"]) == ("g", 1, 1) and rows["g"]["after"] is None
    assert tuple(rows["c"]["before"]) == ("c", 1, None)
    assert tuple(rows["c"]["after"]) == ("c", 2, None)


def test_a_row_of_nulls_is_still_a_row(spark):
    """A present row with nothing but nulls beside its key is not mistaken for an absent one."""
    empty, nulls = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("a", None, None)], SCHEMA)
    assert ops(change_feed(empty, nulls, "k")) == [("I", "a")]
    assert ops(change_feed(nulls, empty, "k")) == [("D", "a")]
    assert ops(change_feed(nulls, nulls, "k")) == []


def test_null_keys_match_nothing_in_the_plain_operators(spark):
    row = spark.createDataFrame([(None, 9, 9)], SCHEMA)
    assert inserts(row, row, "k").count() == 1
    assert deletes(row, row, "k").count() == 1
    assert updates(row, row, "k").count() == 0


def test_repeated_keys_multiply_in_the_plain_operator(spark):
    previous = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], SCHEMA)
    latest = spark.createDataFrame([("a", 3, 3)], SCHEMA)
    assert updates(previous, latest, "k").count() == 2


def test_null_key_fails_the_feed(spark):
    row = spark.createDataFrame([(None, 9, 9)], SCHEMA)
    with pytest.raises(Exception, match="null key"):
        change_feed(row, row, "k").collect()


def test_assert_key(spark, states):
    assert assert_key(states[0], "k") == 6
    assert assert_key(states[0].limit(0), "k") == 0
    with pytest.raises(KeyViolation, match="1 rows with a null key, 0 repeated"):
        assert_key(spark.createDataFrame([(None, 1, 1), ("a", 1, 1)], SCHEMA), "k")
    with pytest.raises(KeyViolation, match="0 rows with a null key, 1 repeated"):
        assert_key(spark.createDataFrame([("a", 1, 1), ("a", 1, 1)], SCHEMA), "k")
    with pytest.raises(ValueError, match="zz"):
        assert_key(states[0], "zz")


def test_composite_key(spark):
    previous = spark.createDataFrame([(1, "x", 1), (1, "y", 1), (2, "x", 1)], "a int, b string, v int")
    latest = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (3, "x", 1)], "a int, b string, v int")
    feed = change_feed(previous, latest, ["a", "b"])
    assert sorted((r["op"], r["a"], r["b"]) for r in feed.collect()) == [
        ("D", 2, "x"),
        ("I", 3, "x"),
        ("U", 1, "y"),
    ]
    with pytest.raises(KeyViolation):
        assert_key(previous, "a")
    assert assert_key(previous, ["a", "b"]) == 3


def test_key_is_found_whatever_its_case(spark):
    previous = spark.createDataFrame([("a", 1)], "UserId string, v int")
    latest = spark.createDataFrame([("a", 2)], "userid string, v int")
    assert change_feed(previous, latest, "USERID").first()["op"] == "U"


def test_applying_a_feed_whatever_the_case_of_names(spark):
    previous = spark.createDataFrame([("a", 1), ("b", 1)], "UserId string, V int")
    latest = spark.createDataFrame([("a", 2), ("b", 1)], "userid string, v int")
    applied = apply_changes(previous, change_feed(previous, latest, "userid"), "userid")
    assert sorted(map(tuple, applied.collect())) == [("a", 2), ("b", 1)]


def test_result_of_nothing_but_its_key(spark):
    previous, latest = (spark.createDataFrame([(i,) for i in ids], "k int") for ids in ([1, 2], [2, 3]))
    assert ops(change_feed(previous, latest, "k")) == [("D", 1), ("I", 3)]
    assert updates(previous, latest, "k").count() == 0


def test_nan_and_signed_zero_are_no_changes(spark):
    previous = spark.createDataFrame([("a", float("nan")), ("b", 0.0)], "k string, v double")
    latest = spark.createDataFrame([("a", float("nan")), ("b", -0.0)], "k string, v double")
    assert change_feed(previous, latest, "k").count() == 0


def test_columns_with_dots_and_quotes(spark):
    previous = spark.createDataFrame([("a", 1)], "`k.1` string, `v``2` int")
    latest = spark.createDataFrame([("a", 2), ("b", 1)], "`k.1` string, `v``2` int")
    feed = change_feed(previous, latest, "k.1")
    assert sorted(r["op"] for r in feed.collect()) == ["I", "U"]
    assert inserts(previous, latest, "k.1").count() == 1
    assert updates(previous, latest, "k.1").count() == 1
    assert apply_changes(previous, feed, "k.1").count() == 2


NESTED = (
    "k string, m map<string,int>, s struct<m: map<string, map<int,int>>, n: int>, "
    "a array<map<string,int>>"
)


@pytest.mark.parametrize("null_safe", [True, False])
def test_maps_compare_by_content_at_any_depth(spark, null_safe):
    def row(k, m, inner, a):
        return (k, m, ({"x": inner}, 1), [a])

    previous = [
        row("same", {"a": 1, "b": 2}, {1: 1, 2: 2}, {"p": 1, "q": 2}),
        row("map", {"a": 1}, {1: 1}, {"p": 1}),
        row("inner", {"a": 1}, {1: 1}, {"p": 1}),
        row("array", {"a": 1}, {1: 1}, {"p": 1}),
    ]
    latest = [
        row("same", {"b": 2, "a": 1}, {2: 2, 1: 1}, {"q": 2, "p": 1}),
        row("map", {"a": 2}, {1: 1}, {"p": 1}),
        row("inner", {"a": 1}, {1: 2}, {"p": 1}),
        row("array", {"a": 1}, {1: 1}, {"p": 2}),
    ]
    states = spark.createDataFrame(previous, NESTED), spark.createDataFrame(latest, NESTED)
    changed = ["array", "inner", "map"]
    assert keys(updates(*states, "k", null_safe)) == changed
    assert keys(change_feed(*states, "k", null_safe)) == changed


def test_null_map_differs_from_empty_map(spark):
    previous = spark.createDataFrame([("a", None)], "k string, m map<string,int>")
    latest = spark.createDataFrame([("a", {})], "k string, m map<string,int>")
    assert change_feed(previous, latest, "k").count() == 1


# --- schema changes -----------------------------------------------------------------------


def test_added_column_is_null_in_the_previous_result(spark):
    previous = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    latest = spark.createDataFrame([("a", 1, None), ("b", 1, 2)], "k string, v int, w int")
    feed = change_feed(previous, latest, "k")
    assert ops(feed) == [("U", "b")]
    assert sorted(map(tuple, apply_changes(previous, feed, "k").collect())) == [
        ("a", 1, None),
        ("b", 1, 2),
    ]


def test_dropped_and_retyped_columns_are_named(spark):
    previous = spark.createDataFrame([("a", 1, 1)], "k string, v int, w int")
    with pytest.raises(SchemaChange, match="w"):
        change_feed(previous, previous.drop("w"), "k")
    with pytest.raises(SchemaChange, match="int -> bigint"):
        updates(previous, previous.withColumn("w", F.lit(1).cast("bigint")), "k")


def test_column_order_does_not_matter(spark, states):
    previous, latest = states
    assert ops(change_feed(previous.select("o", "k", "v"), latest, "k")) == ops(
        change_feed(previous, latest, "k")
    )


def test_run_time_is_carried(states):
    from datetime import datetime, timezone

    run_ts = datetime(2024, 5, 6, 7, 8, 9, 10, tzinfo=timezone.utc)
    row = change_feed(*states, "k", run_ts=run_ts).first()
    assert row["run_ts"].astimezone(timezone.utc) == run_ts

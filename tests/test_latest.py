import pytest
from pyspark.sql import functions as F

from plan_text import count_of, plan
from tabledeltas.operators import as_table, fold_latest, project_value
from tabledeltas.plans import fixture as fx

LOG = (
    "key struct<userId: string>, value struct<userid: string, v: string, w: int>, "
    "`partition` int, offset bigint, timestamp timestamp"
)
KEYS = {"userid": "key.userId"}


def record(user, v, offset, partition=0, t=0):
    value = None if v is None else (user, v, len(v))
    return ((user,), value, partition, offset, fx_time(t))


def fx_time(t):
    from datetime import datetime, timedelta

    return datetime(2024, 1, 1) + timedelta(seconds=t)


@pytest.fixture
def log(spark):
    rows = [record("u1", "A", 0), record("u1", "B", 1), record("u2", "C", 2), record("u2", None, 3)]
    return spark.createDataFrame(rows, LOG)


def test_newest_value_wins_and_a_tombstone_deletes(log):
    folded = {r["userid"]: r for r in fold_latest(log, KEYS).collect()}
    assert folded["u1"]["value"]["v"] == "B" and folded["u1"]["ord"] == 1
    assert folded["u2"]["value"] is None and folded["u2"]["ord"] == 3
    table = as_table(fold_latest(log, KEYS), ["userid"])
    assert [tuple(r) for r in table.collect()] == [("u1", "B", 1)]


def test_a_record_after_a_tombstone_brings_the_key_back(spark, log):
    more = log.union(spark.createDataFrame([record("u2", "D", 4)], LOG))
    assert sorted(r["v"] for r in as_table(fold_latest(more, KEYS)).collect()) == ["B", "D"]


def test_late_record_loses(spark):
    rows = [record("u1", "new", 9), record("u1", "old", 1)]
    df = spark.createDataFrame(rows, LOG).coalesce(1)
    assert fold_latest(df, KEYS).first()["value"]["v"] == "new"


def test_projection_keeps_tombstones_null(log):
    projected = project_value(log, ["userid", "v"])
    assert projected.schema["value"].dataType.names == ["userid", "v"]
    assert projected.where("value IS NULL").count() == 1
    assert as_table(fold_latest(projected, KEYS)).columns == ["userid", "v"]


def test_order_by_several_columns(spark):
    rows = [record("u1", "late", 1, partition=1, t=9), record("u1", "early", 7, partition=0, t=1)]
    df = spark.createDataFrame(rows, LOG)
    with pytest.raises(Exception, match="two partitions"):
        fold_latest(df, KEYS).collect()
    by_time = fold_latest(df, KEYS, order_by=["timestamp", "offset"])
    assert by_time.first()["value"]["v"] == "late"


@pytest.mark.parametrize("order_by", ["offset", ["timestamp", "offset"]])
def test_null_order_fails(spark, order_by):
    df = spark.createDataFrame([record("u1", "A", None), record("u1", "B", 1)], LOG)
    with pytest.raises(Exception, match="null order"):
        fold_latest(df, KEYS, order_by=order_by).collect()


def test_value_must_be_a_struct(spark):
    df = spark.createDataFrame([("a", "text")], "userid string, value string")
    with pytest.raises(TypeError, match="'value' must be a struct, found string"):
        as_table(df)


def test_composite_key(spark):
    df = spark.createDataFrame(
        [(1, "x", (1,), 0), (1, "x", (2,), 1), (1, "y", (3,), 0)],
        "a int, b string, value struct<v: int>, offset bigint",
    )
    folded = fold_latest(df, {"a": "a", "b": "b"})
    assert sorted(tuple(r) for r in folded.select("a", "b", "value.v").collect()) == [
        (1, "x", 2),
        (1, "y", 3),
    ]


def test_hot_key_is_combined_before_the_shuffle(spark):
    """One key with most of the rows leaves each task as one row."""
    df = spark.range(0, 9000, numPartitions=6).select(
        F.struct(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("userId")).alias("key"),
        F.struct("id").alias("value"),
        F.col("id").alias("offset"),
    )
    folded = fold_latest(df, KEYS)
    assert count_of(folded, "SortAggregate") == 2 and count_of(folded, "Exchange") == 1
    rows = {r["userid"]: r["value"]["id"] for r in folded.collect()}
    assert rows[0] == 8999 and len(rows) == 3000


def test_join_on_the_key_needs_no_second_shuffle(spark, small):
    no_broadcast = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in no_broadcast.items():
        spark.conf.set(k, v)
    try:
        sample = fx.sample_result(spark, small)
        assert count_of(sample, "SortMergeJoin") == 1
        assert count_of(sample, "Exchange") == 2  # one per fold
    finally:
        for k in no_broadcast:
            spark.conf.unset(k)


def test_only_the_projected_fields_are_read(spark, small):
    log = project_value(fx.xx_log(spark, small), ["name"])
    text = plan(fold_latest(log, KEYS))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string>" in text


MOVED = [("u", (1,), 0, 500), ("u", (2,), 17, 3), ("w", (3,), 1, 7), ("w", (4,), 1, 8)]


def test_a_key_in_two_partitions_fails_unless_ordered_otherwise(spark):
    df = spark.createDataFrame(MOVED, "k string, value struct<n: int>, partition int, offset long")
    with pytest.raises(Exception, match="two partitions"):
        fold_latest(df, {"k": "k"}).collect()
    rows = fold_latest(df, {"k": "k"}, order_by=["partition", "offset"]).collect()
    assert {r["k"]: r["value"]["n"] for r in rows} == {"u": 2, "w": 4}
    rows = fold_latest(df.where("k = 'w'"), {"k": "k"}, keep_partition=True).collect()
    assert [(r["value"]["n"], r["partition"]) for r in rows] == [(4, 1)]

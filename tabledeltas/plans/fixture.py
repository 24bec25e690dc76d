"""The topics ``xx`` and ``yy`` filled from the driver's tables."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledeltas.functions.envelope import JsonCodec
from tabledeltas.operators.latest import as_table, fold_latest
from tabledeltas.plans.runner import query_result
from tabledeltas.streaming.bronze import TopicSchema

KEYS = {"userid": "key.userId"}

# The declared record schemas, keys as bigint and regionid as int here.
XX_KEY = YY_KEY = T.StructType([T.StructField("userId", T.LongType(), False)])
XX_VALUE = T.StructType(
    [
        T.StructField("userid", T.LongType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("gender", T.StringType(), False),
        T.StructField("regionid", T.IntegerType(), False),
    ]
)
YY_VALUE = T.StructType(
    [
        T.StructField("userid", T.LongType(), False),
        T.StructField("refcount", T.IntegerType(), False),
        T.StructField("optional", T.IntegerType(), True),
    ]
)
SCHEMAS = {"xx": TopicSchema(XX_KEY, XX_VALUE), "yy": TopicSchema(YY_KEY, YY_VALUE)}

# Two writers of the framed topic: the older one does not know the optional field.
OLD_WRITER, NEW_WRITER = 257, 65539
YY_OLD_VALUE = T.StructType(YY_VALUE.fields[:2])
FRAMED = JsonCodec(framed=True, writers={OLD_WRITER: YY_OLD_VALUE, NEW_WRITER: YY_VALUE})

# Records in lists and maps, which the older writer does not know the unit of.
_OLD_ITEM = T.StructType([T.StructField("n", T.IntegerType(), False)])
_ITEM = T.StructType([*_OLD_ITEM.fields, T.StructField("unit", T.IntegerType(), True, {"default": -1})])
_NAMED = T.StructType([*_OLD_ITEM.fields, T.StructField("unit", T.IntegerType())])


def _nested(item: T.StructType, named: T.StructType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("userid", T.LongType(), False),
            T.StructField("items", T.ArrayType(item)),
            T.StructField("by_name", T.MapType(T.StringType(), named)),
        ]
    )


NESTED = _nested(_ITEM, _NAMED)
NESTED_FRAMED = JsonCodec(
    framed=True, writers={OLD_WRITER: _nested(_OLD_ITEM, _OLD_ITEM), NEW_WRITER: NESTED}
)


# Registered versions of the value of yy: the first has another type for a field, the second
# another name for it and no optional field.
WRONG_WRITER, KEY_WRITER = 7, 11


def _avro(name: str, fields: Sequence[dict]) -> str:
    return json.dumps({"type": "record", "name": name, "fields": list(fields)})


_ID = {"name": "userid", "type": "long"}
REGISTERED = [
    ("yy", "key", 1, KEY_WRITER, _avro("Key", [{"name": "userId", "type": "long"}])),
    ("yy", "value", 1, WRONG_WRITER, _avro("Value", [_ID, {"name": "refcount", "type": {"type": "array", "items": "int"}}])),
    ("yy", "value", 2, OLD_WRITER, _avro("Value", [_ID, {"name": "count", "type": "int"}])),
    (
        "yy",
        "value",
        3,
        NEW_WRITER,
        _avro(
            "Value",
            [
                _ID,
                {"name": "refcount", "type": ["int", "long"], "aliases": ["count"]},
                {"name": "optional", "type": ["int", "null"], "default": -1},
            ],
        ),
    ),
    ("xx", "value", 9, 9, _avro("Other", [{"name": "name", "type": "string"}])),
]

# The partitions declared for each topic.
TOPIC_PARTITIONS = 16

SAMPLE_SQL = """
SELECT userid, people.gender, people.name, people.regionid, counts.optional, counts.refcount
FROM yy AS counts JOIN xx AS people USING (userid)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- changelogs: key, value, offset -------------------------------------------------------


def xx_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One upsert per customer."""
    return table(spark, sf_dir, "customer").select(
        F.struct(F.col("c_custkey").alias("userId")).alias("key"),
        F.struct(
            F.col("c_custkey").alias("userid"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("gender"),
            F.col("c_nationkey").alias("regionid"),
        ).alias("value"),
        F.col("c_custkey").alias("offset"),
        F.timestamp_seconds("c_custkey").alias("timestamp"),
    )


def props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def yy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per event; an error deletes its user."""
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", props_k())
        .select(
            F.struct(F.col("user_id").alias("userId")).alias("key"),
            F.when(
                F.col("event_type") != "error",
                F.struct(
                    F.col("user_id").alias("userid"),
                    (F.col("k") % 2).alias("refcount"),
                    F.when(F.col("event_type") != "click", F.expr("CAST(k DIV 50 AS INT)")).alias(
                        "optional"
                    ),
                ),
            ).alias("value"),
            F.col("event_id").alias("offset"),
            F.col("ts").cast("timestamp").alias("timestamp"),
        )
    )


def before_cut(spark: SparkSession, sf_dir: str, log: DataFrame, tenths: int = 9) -> DataFrame:
    """The records below the given tenths of the offsets."""
    size = table(spark, sf_dir, "events").agg(F.count(F.lit(1))).scalar()
    return log.where(F.col("offset") * 10 < size * tenths)


def slice_of(
    spark: SparkSession, sf_dir: str, log: DataFrame, part: int | tuple[int, int], parts: int
) -> DataFrame:
    """One of ``parts`` equal ranges of the offsets, in order, or those from one up to another."""
    first, last = part if isinstance(part, tuple) else (part, part + 1)
    size = table(spark, sf_dir, "events").agg(F.count(F.lit(1))).scalar()
    at = F.col("offset") * parts
    return log.where((at >= size * first) & (at < size * last))


# --- topic tables and the sample result ---------------------------------------------------


def topic_tables(spark: SparkSession, sf_dir: str, tenths: int = 10) -> dict[str, DataFrame]:
    """``xx`` and ``yy`` as tables, ``yy`` as of a cut-off."""
    yy = yy_log(spark, sf_dir)
    if tenths < 10:
        yy = before_cut(spark, sf_dir, yy, tenths)
    return {
        "xx": as_table(fold_latest(xx_log(spark, sf_dir), KEYS), ["userid"]),
        "yy": as_table(fold_latest(yy, KEYS), ["userid"]),
    }


def sample_result(spark: SparkSession, sf_dir: str, tenths: int = 10) -> DataFrame:
    return query_result(spark, SAMPLE_SQL, topic_tables(spark, sf_dir, tenths))


def order_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the orders, by rule: the larger pair for benchmarks."""
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    previous = orders.where(k % 10 != 0).withColumn(
        "o_orderpriority", F.when(k % 7 != 0, F.col("o_orderpriority"))
    )
    latest = orders.where(k % 10 != 1).withColumn(
        "o_orderstatus", F.when(k % 10 == 2, "F").otherwise(F.col("o_orderstatus"))
    )
    return previous, latest


# --- raw topics ---------------------------------------------------------------------------


def raw_topic(log: DataFrame, topic: str, value: Column | None = None) -> DataFrame:
    """A changelog as the binary records of a topic; a null value stays a tombstone."""
    body = F.to_json("value", {"ignoreNullFields": "false"}) if value is None else value
    return log.select(
        F.to_json("key").cast("binary").alias("key"),
        body.cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.pmod("key.userId", F.lit(TOPIC_PARTITIONS)).cast("int").alias("partition"),
        "offset",
        "timestamp",
        F.lit(0).alias("timestampType"),
    )


def framed(schema_id: Column, body: Column) -> Column:
    """A body behind the frame's header."""
    header = F.unhex(F.lpad(F.hex(schema_id), 10, "0"))
    return F.concat(header, body.cast("binary"))


def registered_yy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``yy`` by the writers of ``REGISTERED``, in turn."""
    turn = F.col("offset") % 3
    bodies = {
        WRONG_WRITER: F.struct("value.userid", F.array("value.refcount").alias("refcount")),
        OLD_WRITER: F.struct("value.userid", F.col("value.refcount").alias("count")),
        NEW_WRITER: F.struct("value.userid", "value.refcount", "value.optional"),
    }
    body = F.lit(None).cast("binary")
    for i, (writer, record) in enumerate(bodies.items()):
        text = F.to_json(record, {"ignoreNullFields": "false"})
        body = F.when(turn == i, framed(F.lit(writer), text)).otherwise(body)
    body = F.when(F.col("value").isNotNull(), body)
    raw = raw_topic(yy_log(spark, sf_dir), "yy", body)
    return raw.withColumn("key", framed(F.lit(KEY_WRITER), F.col("key")))

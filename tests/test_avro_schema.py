import json

import pytest
from pyspark.sql import types as T

from tabledeltas.functions import AvroCodec, JsonCodec
from tabledeltas.functions.avro_schema import avro_struct
from tabledeltas.streaming import topic_schema


def record(*fields, **more):
    return json.dumps({"type": "record", "name": "r", "fields": list(fields), **more})


def field(name, kind, **more):
    return {"name": name, "type": kind, **more}


VALUE = record(
    field("userid", "string"), field("refcount", "int"), field("optional", ["int", "null"])
)


def test_records_of_the_topics():
    assert avro_struct(VALUE) == T.StructType(
        [
            T.StructField("userid", T.StringType(), False),
            T.StructField("refcount", T.IntegerType(), False),
            T.StructField("optional", T.IntegerType(), True),
        ]
    )
    sample = avro_struct(record(field("userName", "string"), field("accountNumber", "long")))
    assert [f.dataType.simpleString() for f in sample] == ["string", "bigint"]


@pytest.mark.parametrize(
    ("kind", "ddl"),
    [
        ("boolean", "boolean"),
        ("float", "float"),
        ("double", "double"),
        ("bytes", "binary"),
        ({"type": "int", "logicalType": "date"}, "date"),
        ({"type": "long", "logicalType": "timestamp-micros"}, "timestamp"),
        ({"type": "long", "logicalType": "timestamp-millis"}, "timestamp"),
        ({"type": "long", "logicalType": "unheard-of"}, "bigint"),
        ({"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}, "decimal(9,2)"),
        ({"type": "array", "items": ["null", "string"]}, "array<string>"),
        ({"type": "map", "values": "long"}, "map<string,bigint>"),
        ({"type": "enum", "name": "e", "symbols": ["A"]}, "string"),
        ({"type": "fixed", "name": "f", "size": 4}, "binary"),
        ({"type": {"type": "string"}}, "string"),
        ({"type": "record", "name": "n", "fields": [field("a", "int")]}, "struct<a:int>"),
        (["int", "long"], "bigint"),
        (["null", "long", "int"], "bigint"),
        (["float", "null", "double"], "double"),
        (["int", "string"], "struct<member0:int,member1:string>"),
        (["string", "null", {"type": "array", "items": "long"}], "struct<member0:string,member1:array<bigint>>"),
        (["float", "long"], "struct<member0:float,member1:bigint>"),
        (["int"], "int"),
        (["null"], "void"),
    ],
)
def test_types(kind, ddl):
    assert avro_struct(record(field("x", kind)))["x"].dataType.simpleString() == ddl


def test_named_types_defaults_and_refusals():
    inner = {"type": "fixed", "name": "id", "size": 4}
    struct = avro_struct(record(field("a", inner), field("b", "n.s.id"), field("c", "int", default=3), namespace="n.s"))
    assert struct["b"].dataType == T.BinaryType()
    assert struct["c"].metadata == {"default": 3}
    with pytest.raises(ValueError, match="recursive"):
        avro_struct(record(field("x", "r")))
    with pytest.raises(ValueError, match="record"):
        avro_struct('"int"')


def test_unions_are_nullable_with_null_only():
    struct = avro_struct(record(field("a", ["int", "long"]), field("b", ["int", "string", "null"])))
    assert [f.nullable for f in struct] == [False, True]
    assert all(f.nullable for f in struct["b"].dataType)


def test_aliases_go_to_the_metadata():
    struct = avro_struct(record(field("a", "int", aliases=["was", "before"]), field("b", "int")))
    assert [f.metadata for f in struct] == [{"aliases": ["was", "before"]}, {}]


def test_json_bodies_of_avro_records(spark):
    """Every version is a writer; the newest one is the topic's schema."""
    old = record(field("userid", "string"), field("n", "int"))
    new = record(field("userid", "string"), field("refcount", ["int", "long"], aliases=["n"]))
    rows = [("a", "key", 1, 1, record(field("userId", "string"))), ("a", "value", 1, 2, old), ("a", "value", 2, 3, new)]
    table = spark.createDataFrame(rows, "topic string, side string, version int, schema_id int, schema string")
    schema = topic_schema(table, "a", json_bodies=True)
    assert schema.value == avro_struct(new)
    assert schema.value_codec == JsonCodec(framed=True, writers={2: avro_struct(old), 3: avro_struct(new)})


def test_topic_schema_picks_the_codec(spark):
    key = record(field("userId", "string"))
    spark_value = avro_struct(VALUE).json()
    rows = [("a", "key", 1, 1, key), ("a", "value", 1, 2, VALUE), ("a", "value", 2, 3, VALUE)]
    rows += [("j", "key", 1, 4, key), ("j", "value", 1, 5, spark_value)]
    rows += [("m", "key", 1, 4, key), ("m", "value", 1, 5, spark_value), ("m", "value", 2, 6, VALUE)]
    table = spark.createDataFrame(rows, "topic string, side string, version int, schema_id int, schema string")
    avro = topic_schema(table, "a")
    assert avro.value_codec == AvroCodec(VALUE, {2: VALUE, 3: VALUE})
    assert avro.value == avro_struct(VALUE)
    assert isinstance(topic_schema(table, "j").value_codec, JsonCodec)
    with pytest.raises(ValueError, match="partly Avro"):
        topic_schema(table, "m")

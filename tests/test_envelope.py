import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plan_text import plan
from tabledeltas.functions import (
    AvroCodec,
    CodecUnavailable,
    JsonCodec,
    SchemaMismatch,
    accepted,
    decode_envelope,
    frame_body,
    frame_schema_id,
    latest_schemas,
    rejected,
)

SCHEMA = T.StructType(
    [
        T.StructField("userid", T.LongType(), False),
        T.StructField("refcount", T.IntegerType(), False),
        T.StructField("optional", T.IntegerType(), True),
    ]
)


def topic(spark, payloads):
    rows = [(i, b'{"userId":1}', p) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "offset int, key binary, value binary")


def outcome(df):
    return {
        r["offset"]: (tuple(r["value"]) if r["value"] else None, r["_reject"] and r["_reject"]["reason"])
        for r in df.collect()
    }


def test_rows_tombstones_and_rejects_are_kept_apart(spark):
    payloads = [
        b'{"userid":1,"refcount":2,"optional":3}',
        b'{"userid":1,"refcount":2}',
        None,
        b"not json",
        b"",
        b"null",
        b'{"userid":"x","refcount":2}',
        b'{"userid":1}',
        b"{}",
        b'{"userid":1,"refcount":99999999999}',
    ]
    df = decode_envelope(topic(spark, payloads), "value", SCHEMA)
    assert outcome(df) == {
        0: ((1, 2, 3), None),
        1: ((1, 2, None), None),
        2: (None, None),
        3: (None, "malformed"),
        4: (None, "malformed"),
        5: (None, "malformed"),
        6: (None, "malformed"),
        7: (None, "missing refcount"),
        8: (None, "missing userid"),
        9: (None, "malformed"),
    }
    assert accepted(df).count() == 3
    raw = {r["offset"]: bytes(r["payload"]) for r in rejected(df).collect()}
    assert raw[3] == b"not json" and raw[4] == b"" and len(raw) == 7


@pytest.mark.parametrize(
    "payload",
    [
        b'{"userid":1,"refcount":2} xyz',
        b'{"userid":1,"refcount":2}{"userid":3,"refcount":4}',
        b'{"userid":1,"refcount":2}}',
        b'{"userid":1,"refcount":2}]}',
        b'{"userid":1,"refcount":2},{"userid":3,"refcount":4}',
        b'{"userid":1,"refcount":2},"x":1',
        b'{"userid":1,"refcount":2},',
        b'{"userid":1,"refcount":2',
        b'[{"userid":1,"refcount":2}]',
        b'"text"',
        b"1",
        b"  ",
        b"\xff\xfe",
        b'{"userid":1,"refcount":2.5}',
        b'{"userid":1,"refcount":2,"optional":"x"}',
        b'{"userid":1,"refcount":2,"optional":{}}',
    ],
)
def test_body_must_be_one_whole_object(spark, payload):
    df = decode_envelope(topic(spark, [payload]), "value", SCHEMA)
    assert outcome(df) == {0: (None, "malformed")}


@pytest.mark.parametrize(
    "payload",
    [
        b' {"userid":1,"refcount":2} \n',
        b'{"refcount":2,"more":{"a":[1]},"userid":1}',
        b'{"userid":1,"refcount":2,"optional":null}',
    ],
)
def test_blanks_order_and_further_fields_do_not_matter(spark, payload):
    df = decode_envelope(topic(spark, [payload]), "value", SCHEMA)
    assert outcome(df) == {0: ((1, 2, None), None)}


def test_column_is_replaced_in_place_whatever_its_case(spark):
    df = topic(spark, [b'{"userid":1,"refcount":2}']).withColumn("after", F.lit(1))
    decoded = decode_envelope(df, "VALUE", SCHEMA)
    assert decoded.columns == ["offset", "key", "value", "after", "_reject"]
    assert decoded.schema["value"].dataType.names == ["userid", "refcount", "optional"]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="no column 'body'"):
        decode_envelope(topic(spark, [None]), "body", SCHEMA)


def test_null_key_is_a_reject_and_the_first_reject_is_kept(spark):
    key = T.StructType([T.StructField("userId", T.LongType(), False)])
    df = spark.createDataFrame(
        [(0, None, b"bad"), (1, b'{"userId":1}', b"bad"), (2, b"bad", None)],
        "offset int, key binary, value binary",
    )
    decoded = decode_envelope(decode_envelope(df, "key", key, required=True), "value", SCHEMA)
    assert {r["offset"]: (r["column"], r["reason"]) for r in rejected(decoded).collect()} == {
        0: ("key", "null key"),
        1: ("value", "malformed"),
        2: ("key", "malformed"),
    }


def frame(schema_id: int, body: bytes) -> bytes:
    return b"\x00" + schema_id.to_bytes(4, "big") + body


def test_frame_header(spark):
    payloads = [frame(258, b"abc"), frame(2**31 + 5, b""), b"\x01\x00\x00\x00\x01x", b"\x00\x00", None]
    df = topic(spark, payloads).select(
        "offset", frame_schema_id(F.col("value")).alias("id"), frame_body(F.col("value")).alias("body")
    )
    rows = {r["offset"]: (r["id"], None if r["body"] is None else bytes(r["body"])) for r in df.collect()}
    assert rows == {
        0: (258, b"abc"),
        1: (2**31 + 5, b""),
        2: (None, None),
        3: (None, None),
        4: (None, None),
    }


OLD = T.StructType(SCHEMA.fields[:2])
NARROW = T.StructType(
    [T.StructField("userid", T.IntegerType()), T.StructField("refcount", T.IntegerType())]
)


def test_each_writer_is_read_with_its_own_schema(spark):
    codec = JsonCodec(framed=True, writers={1: OLD, 2: SCHEMA, 3: NARROW})
    payloads = [
        frame(1, b'{"userid":1,"refcount":2,"optional":3}'),
        frame(2, b'{"userid":1,"refcount":2,"optional":3}'),
        frame(3, b'{"userid":7,"refcount":8}'),
        frame(9, b'{"userid":1,"refcount":2}'),
        b'{"userid":1,"refcount":2}',
        frame(2, b"bad"),
        None,
    ]
    df = decode_envelope(topic(spark, payloads), "value", SCHEMA, codec)
    assert outcome(df) == {
        0: ((1, 2, None), None),
        1: ((1, 2, 3), None),
        2: ((7, 8, None), None),
        3: (None, "unknown schema id"),
        4: (None, "no frame"),
        5: (None, "malformed"),
        6: (None, None),
    }


NO_REFCOUNT = T.StructType(SCHEMA.fields[:1])


def test_records_of_unreadable_writers_are_rejects(spark):
    text = T.StructType([T.StructField("userid", T.StringType()), SCHEMA.fields[1]])
    codec = JsonCodec(framed=True, writers={1: NO_REFCOUNT, 2: text, 3: SCHEMA})
    payloads = [frame(i, b'{"userid":1,"refcount":2}') for i in (1, 2, 3, 4)]
    assert outcome(decode_envelope(topic(spark, payloads), "value", SCHEMA, codec)) == {
        0: (None, "incompatible schema id"),
        1: (None, "incompatible schema id"),
        2: ((1, 2, None), None),
        3: (None, "unknown schema id"),
    }
    with pytest.raises(SchemaMismatch):
        decode_envelope(topic(spark, [None]), "value", SCHEMA, JsonCodec(framed=True, writers={1: text}))


def test_default_of_a_field_the_writer_lacks(spark):
    tags = T.StructField("tags", T.ArrayType(T.StringType()), False, {"default": ["x"]})
    count = T.StructField("refcount", T.IntegerType(), False, {"default": 7})
    reader = T.StructType([SCHEMA.fields[0], count, tags])
    codec = JsonCodec(framed=True, writers={1: NO_REFCOUNT, 2: reader})
    payloads = [frame(1, b'{"userid":1}'), frame(2, b'{"userid":1,"refcount":2,"tags":[]}'), frame(2, b'{"userid":1}')]
    assert outcome(decode_envelope(topic(spark, payloads), "value", reader, codec)) == {
        0: ((1, 7, ["x"]), None),
        1: ((1, 2, []), None),
        2: (None, "missing refcount"),
    }


def test_equal_writers_share_a_parser(spark):
    codec = JsonCodec(framed=True, writers={i: (OLD if i % 2 else SCHEMA) for i in range(100)})
    df = decode_envelope(topic(spark, [frame(99, b'{"userid":1,"refcount":2}')]), "value", SCHEMA, codec)
    assert plan(df).count("from_json") == 3
    assert outcome(df) == {0: ((1, 2, None), None)}


FORGED = [
    b'{"userid":1,"refcount":1}],"z":[1',
    b'{"userid":1,"refcount":1}],"bodies":[{"userid":2,"refcount":9}',
    b'{"userid":1,"refcount":1},{"userid":2,"refcount":9}',
    b'{"userid":1,"refcount":1},{"_end":"1"}],[{"userid":2,"refcount":9}',
    b'{"userid":1,"refcount":1}]',
    b'{"userid":1,"refcount":1},{"_end":"0"}]',
    b'{"userid":1,"refcount":1}, ',
    b'{"userid":1,"refcount":1} {}',
    b'[{"userid":1,"refcount":1}]',
    b'1',
    b'"x"',
]


def test_bodies_that_close_their_wrapper_are_malformed(spark):
    assert outcome(decode_envelope(topic(spark, FORGED), "value", SCHEMA)) == {
        i: (None, "malformed") for i in range(len(FORGED))
    }


def test_nested_required_fields(spark):
    schema = T.StructType(
        [T.StructField("a", T.StructType([T.StructField("b", T.IntegerType(), False)]), True)]
    )
    df = decode_envelope(topic(spark, [b'{"a":{"b":1}}', b'{"a":{}}', b'{"a":null}', b"{}"]), "value", schema)
    reasons = [r["_reject"] and r["_reject"]["reason"] for r in df.orderBy("offset").collect()]
    assert reasons == [None, "missing a.b", None, None]


def struct(*fields):
    return T.StructType([T.StructField(*f) for f in fields])


def framed_bodies(spark, *bodies):
    return topic(spark, [bytes([0, 0, 0, 0, i]) + body for i, body in bodies])


def test_evolution_below_arrays_and_maps(spark):
    """A field added to records in a list, in a map and in a list of maps of lists: its default,
    or null; a wider number and a former name as well."""
    old = struct(("a", T.IntegerType()), ("was", T.IntegerType()))
    new = struct(
        ("a", T.LongType()),
        ("b", T.IntegerType(), True, {"aliases": ["was"]}),
        ("c", T.StringType(), True, {"default": "x"}),
        ("d", T.StringType()),
    )

    def around(item):
        return struct(
            ("l", T.ArrayType(item)),
            ("m", T.MapType(T.StringType(), item)),
            ("deep", T.ArrayType(T.MapType(T.StringType(), T.ArrayType(item)))),
            ("n", T.ArrayType(T.LongType() if item is new else T.IntegerType())),
        )

    codec = JsonCodec(framed=True, writers={1: around(old), 2: around(new)})
    items = b'{"a":1,"was":2}'
    body = b'{"l":[%s,null],"m":{"k":%s},"deep":[{"k":[%s]}],"n":[3,null]}' % (items, items, items)
    later = b'{"l":[{"a":5,"b":6,"c":"y","d":"z"}],"m":null}'
    df = framed_bodies(spark, (1, body), (2, later), (1, b'{"l":[]}'))
    rows = [r["value"] for r in decode_envelope(df, "value", around(new), codec).orderBy("offset").collect()]
    read = (1, 2, "x", None)
    assert [x and tuple(x) for x in rows[0]["l"]] == [read, None]
    assert tuple(rows[0]["m"]["k"]) == tuple(rows[0]["deep"][0]["k"][0]) == read
    assert rows[0]["n"] == [3, None]
    assert tuple(rows[1]["l"][0]) == (5, 6, "y", "z") and rows[1]["m"] is None
    assert rows[2]["l"] == [] and rows[2]["deep"] is None


def test_required_fields_below_arrays_and_maps(spark):
    item = struct(("a", T.IntegerType(), False))
    schema = struct(("l", T.ArrayType(item)), ("m", T.MapType(T.StringType(), T.ArrayType(item))))
    bodies = [b'{"l":[{"a":1},null]}', b'{"l":[{"a":1},{}]}', b'{"m":{"x":[{"a":1}],"y":[{"a":null}]}}', b'{"l":[]}']
    df = decode_envelope(topic(spark, bodies), "value", schema)
    reasons = [r["_reject"] and r["_reject"]["reason"] for r in df.orderBy("offset").collect()]
    assert reasons == [None, "missing l.element.a", "missing m.value.element.a", None]


def test_writers_that_differ_below_an_array_are_incompatible(spark):
    """A required field that records in a list lack, or another type of one; others are read."""
    new = struct(("l", T.ArrayType(struct(("a", T.IntegerType(), False), ("b", T.IntegerType())))))
    lacks = struct(("l", T.ArrayType(struct(("b", T.IntegerType())))))
    other = struct(("l", T.ArrayType(struct(("a", T.ArrayType(T.IntegerType()))))))
    codec = JsonCodec(framed=True, writers={1: lacks, 2: other, 3: new})
    df = framed_bodies(spark, (1, b'{"l":[{"b":1}]}'), (2, b'{"l":[]}'), (3, b'{"l":[{"a":1}]}'))
    found = decode_envelope(df, "value", new, codec).orderBy("offset").collect()
    assert [r["_reject"] and r["_reject"]["reason"] for r in found] == ["incompatible schema id"] * 2 + [None]
    assert tuple(found[2]["value"]["l"][0]) == (1, None)


def test_filter_on_the_outcome_parses_each_body_once(spark):
    df = accepted(decode_envelope(topic(spark, [None]), "value", SCHEMA)).where("value.refcount > 1")
    assert plan(df).count("from_json") == 2  # the value, and that it is one whole value


def test_avro_without_its_module_says_so(spark):
    text = '{"type":"record","name":"r","fields":[{"name":"userid","type":"long"}]}'
    with pytest.raises(CodecUnavailable, match="Avro module"):
        decode_envelope(topic(spark, [None]), "value", SCHEMA, AvroCodec(text, {1: text}))


def test_latest_schemas(spark):
    rows = [
        ("xx", "key", 1, 10, "a"),
        ("xx", "value", 1, 11, "b"),
        ("xx", "value", 3, 9, "d"),
        ("xx", "value", 2, 12, "c"),
        ("yy", "value", 1, 13, "e"),
    ]
    df = spark.createDataFrame(rows, "topic string, side string, version int, schema_id int, schema string")
    assert sorted(tuple(r) for r in latest_schemas(df).collect()) == [
        ("xx", "key", 1, 10, "a"),
        ("xx", "value", 3, 9, "d"),
        ("yy", "value", 1, 13, "e"),
    ]

"""Decoding of topic payloads in place, with built-in expressions only.

A framed payload is one zero byte, the writer schema's id as four bytes, big endian, and the
body. The body is JSON, or Avro where Spark's Avro module is loaded.

Three outcomes are kept apart: a null payload is a tombstone and stays null; a body that
decodes becomes a struct; anything else goes to the reject column with its raw payload and
the reason, never to a table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import partial
from typing import ClassVar

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabledeltas.operators.changes import quoted

# Fixed values of the frame.
MAGIC_BYTE_HEX = "00"
HEADER_BYTES = 5

REJECT_SCHEMA = T.StructType(
    [
        T.StructField("column", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

_CORRUPT = "_corrupt_record"
AVRO_NEEDED = "the Avro codec needs Spark's Avro module on the class path"


class CodecUnavailable(RuntimeError):
    """The module a codec needs is not on Spark's class path."""


class SchemaMismatch(ValueError):
    """A writer schema cannot be read with the topic's schema."""


#: Metadata of a field of the topic's schema: what it is where a writer does not know it, and
#: the names that writers may know it by.
DEFAULT, ALIASES = "default", "aliases"


@dataclass(frozen=True)
class JsonCodec:
    """JSON text. ``writers`` maps a frame's schema id to the schema it was written with;
    without it, or without frames, every body is read with the topic's own schema."""

    framed: bool = False
    writers: Mapping[int, T.StructType] = field(default_factory=dict)


@dataclass(frozen=True)
class AvroCodec:
    """Framed Avro binary. ``writers`` maps a frame's schema id to the Avro schema text;
    ``reader`` is the Avro schema text of the topic's schema."""

    reader: str
    writers: Mapping[int, str]
    framed: ClassVar[bool] = True


# --- frame --------------------------------------------------------------------------------


def frame_schema_id(payload: Column) -> Column:
    """The schema id in a frame's header; null when the payload is no frame."""
    digits = F.hex(F.substring(payload, 2, HEADER_BYTES - 1))
    return F.when(is_framed(payload), F.conv(digits, 16, 10).cast("long"))


def frame_body(payload: Column) -> Column:
    return F.when(is_framed(payload), F.substr(payload, F.lit(HEADER_BYTES + 1)))


def is_framed(payload: Column) -> Column:
    return (F.octet_length(payload) >= HEADER_BYTES) & (
        F.hex(F.substring(payload, 1, 1)) == MAGIC_BYTE_HEX
    )


# --- schema table -------------------------------------------------------------------------


def latest_schemas(schemas: DataFrame) -> DataFrame:
    """Newest version per ``(topic, side)`` of ``(topic, side, version, schema_id, schema)``."""
    newest = F.max_by(F.struct("version", "schema_id", "schema"), "version").alias("s")
    return schemas.groupBy("topic", "side").agg(newest).select("topic", "side", "s.*")


# --- decode -------------------------------------------------------------------------------


def decode_envelope(
    df: DataFrame,
    column: str,
    schema: T.StructType,
    codec: JsonCodec | AvroCodec = JsonCodec(),
    required: bool = False,
    reject_column: str = "_reject",
) -> DataFrame:
    """Decode one binary column in place; the other columns and their order stay.

    ``schema`` is the topic's schema for the whole run: every writer schema is read into it,
    a field it lacks as the default in the field's metadata, else as NULL. A field declared not
    nullable and without a default must be there. Records of a writer whose schema cannot be
    read so are rejects.
    ``required=True`` is for keys: a null payload is then a reject too. The first reject of
    a row is kept in ``reject_column``, as ``struct<column, reason, payload>``.
    """
    spelled = {c.lower(): c for c in df.columns}
    if column.lower() not in spelled:
        raise ValueError(f"no column {column!r} to decode in {df.columns}")
    name = spelled[column.lower()]
    payload = F.col(quoted(name))

    body = F.col("_text") if codec.framed else payload
    bodies, unreadable = _bodies(F.col("_schema_id"), body, schema, codec)
    read = df
    if codec.framed:
        read = _once(df, {"_schema_id": frame_schema_id(payload), "_text": frame_body(payload)})
    try:
        items = {"_items": _as_items(body)} if isinstance(codec, JsonCodec) else {}
        read = _once(read, {n: b.parsed for n, b in bodies.items()} | items)
    except AnalysisException as e:
        if "AVRO" in str(e):
            raise CodecUnavailable(AVRO_NEEDED) from e
        raise
    nothing = F.lit(None).cast(schema)
    whole = _is_one_value(F.col("_items"), body) if items else F.lit(True)
    read = _once(
        read,
        {
            "_value": F.coalesce(*[b.conformed(F.col(n)) for n, b in bodies.items()], nothing),
            "_damaged": ~whole
            | F.coalesce(*[b.damaged(F.col(n)) for n, b in bodies.items()], F.lit(False)),
        },
    )
    value, damaged = F.col("_value"), F.col("_damaged")
    reason = F.when(payload.isNull(), F.lit(f"null {name}") if required else F.lit(None))
    if codec.framed:
        reason = reason.when(F.col("_schema_id").isNull(), F.lit("no frame"))
    if codec.framed and codec.writers:
        unknown = ~F.col("_schema_id").isin(*codec.writers)
        reason = reason.when(unknown, F.lit("unknown schema id"))
    if unreadable:
        wrong = F.col("_schema_id").isin(*unreadable)
        reason = reason.when(wrong, F.lit("incompatible schema id"))
    reason = reason.when(value.isNull() | damaged, F.lit("malformed"))
    for path, missing in _required_nulls(value, schema):
        reason = reason.when(missing, F.lit(f"missing {path}"))

    judged = read.withColumn("_reason", reason)
    reject = F.when(
        F.col("_reason").isNotNull(),
        F.struct(
            F.lit(name).alias("column"),
            F.col("_reason").alias("reason"),
            payload.alias("payload"),
        ),
    )
    earlier = reject_column in df.columns
    kept = F.coalesce(F.col(reject_column), reject) if earlier else reject
    decoded = F.when(F.col("_reason").isNull(), value)
    columns = [
        decoded.alias(c) if c == name else kept.alias(c) if c == reject_column else F.col(quoted(c))
        for c in df.columns
    ]
    if not earlier:
        columns.append(kept.alias(reject_column))
    return judged.select(*columns)


def _once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns as generated ones. They are a barrier: a later filter is not pushed below
    them, where it would evaluate them again for each mention, and each is evaluated once."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def accepted(df: DataFrame, reject_column: str = "_reject") -> DataFrame:
    """Rows in which every column decoded."""
    return df.where(F.col(reject_column).isNull()).drop(reject_column)


def rejected(df: DataFrame, reject_column: str = "_reject") -> DataFrame:
    """Rows that did not decode, with the raw payload that failed."""
    rows = df.where(F.col(reject_column).isNotNull())
    others = [F.col(quoted(c)) for c in df.columns if c not in ("key", "value", reject_column)]
    return rows.select(*others, f"{reject_column}.*")


@dataclass(frozen=True)
class _Body:
    """How the bodies of one writer schema are parsed and brought to the topic's schema."""

    parsed: Column
    conformed: Callable[[Column], Column]
    damaged: Callable[[Column], Column]


def _bodies(
    schema_id: Column, body: Column, schema: T.StructType, codec
) -> tuple[dict[str, _Body], list[int]]:
    """A parser for each distinct writer schema, and the ids of writers that cannot be read."""
    if isinstance(codec, AvroCodec):
        parse = partial(_avro_body, body, codec.reader)
    else:
        parse = partial(_json_body, body, schema)
        if not (codec.framed and codec.writers):
            return {"_body": parse(schema, F.lit(True))}, []
    if not codec.writers:
        raise ValueError("at least one writer schema is needed")
    alike: dict[str, list[int]] = {}
    for i, writer in sorted(codec.writers.items()):
        alike.setdefault(writer if isinstance(writer, str) else writer.json(), []).append(i)
    bodies, unreadable = {}, []
    for ids in alike.values():
        try:
            bodies[f"_body_{ids[0]}"] = parse(codec.writers[ids[0]], schema_id.isin(*ids))
        except SchemaMismatch:
            unreadable += ids
    if not bodies:
        raise SchemaMismatch("no writer schema can be read with the topic's schema")
    return bodies, unreadable


def _as_items(body: Column) -> Column:
    """A body read as the first item of a list, with a mark behind it."""
    text = F.concat(F.lit("["), body.cast("string"), F.lit(',{"_end":"'), _mark(body), F.lit('"}]'))
    return F.from_json(text, T.ArrayType(T.StructType([T.StructField("_end", T.StringType())])))


def _mark(body: Column) -> Column:
    return F.xxhash64(body).cast("string")


def _is_one_value(items: Column, body: Column) -> Column:
    """Whether a body is one whole JSON value and nothing else.

    A parser stops after the first value and would not see what follows it. A body that
    closes the list around it, or holds more items, leaves the mark behind it unread or in
    another place; as the mark depends on the body, a body cannot bring its own.
    """
    mark = _mark(body)
    ends = (F.size(items) == 2) & F.get(items, F.lit(1))["_end"].eqNullSafe(mark)
    return F.coalesce(ends, F.lit(False))


def _json_body(body: Column, reader: T.StructType, writer: T.StructType, mine: Column) -> _Body:
    record = T.StructType(
        [
            *[T.StructField(f.name, f.dataType) for f in writer.fields],
            T.StructField(_CORRUPT, T.StringType()),
        ]
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    conform(F.lit(None).cast(writer), writer, reader)  # fails here if it cannot be read

    def damaged(parsed: Column) -> Column:
        return F.when(parsed.isNotNull(), parsed[_CORRUPT].isNotNull())

    return _Body(
        F.when(mine, F.from_json(body.cast("string"), record, options)),
        lambda parsed: conform(parsed, writer, reader),
        damaged,
    )


#: A field added to the reader's schema that every sound record gets, and no null row has.
_READ = "tabledeltas_read"


def _avro_body(body: Column, reader: str, writer: str, mine: Column) -> _Body:
    from pyspark.sql.avro.functions import from_avro

    marked = json.loads(reader)
    marked["fields"] = [*marked["fields"], {"name": _READ, "type": "boolean", "default": True}]
    names = [f["name"] for f in marked["fields"][:-1]]
    try:
        parsed = from_avro(body, writer, {"mode": "PERMISSIVE", "avroSchema": json.dumps(marked)})
    except (TypeError, AttributeError) as e:
        raise CodecUnavailable(AVRO_NEEDED) from e

    # A malformed Avro body may come back as null or as a row of nulls; neither has the mark.
    def sound(parsed: Column) -> Column:
        return F.coalesce(parsed[_READ], F.lit(False))

    return _Body(
        F.when(mine, parsed),
        lambda v: F.when(sound(v), F.struct(*[v[n].alias(n) for n in names])),
        lambda v: F.when(v.isNotNull(), ~sound(v)),
    )


# The numeric promotions allowed from a writer's type to the topic's type.
PROMOTIONS = {
    ("int", "bigint"),
    ("int", "float"),
    ("int", "double"),
    ("bigint", "float"),
    ("bigint", "double"),
    ("float", "double"),
    ("string", "binary"),
    ("binary", "string"),
}


def conform(value: Column, writer: T.StructType, reader: T.StructType, path: str = "") -> Column:
    """Read a struct of the writer's schema as one of the reader's, by field name, at any depth
    of structs, arrays and maps. A reader's field is found under its aliases as well."""
    written = {f.name: f for f in writer.fields}
    fields = []
    for f in reader.fields:
        at = f"{path}{f.name}"
        names = [f.name, *f.metadata.get(ALIASES, [])]
        source = next((written[n] for n in names if n in written), None)
        if source is None:
            column = _default(f, at)
        else:
            column = _read_as(value[source.name], source.dataType, f.dataType, at)
        fields.append(column.alias(f.name))
    return F.when(value.isNotNull(), F.struct(*fields))


def _default(field_: T.StructField, at: str) -> Column:
    default = field_.metadata.get(DEFAULT)
    if default is None:
        if not field_.nullable:
            raise SchemaMismatch(f"field {at} is required but not in the writer schema")
        return F.lit(None).cast(field_.dataType)
    if isinstance(field_.dataType, (T.StructType, T.ArrayType, T.MapType)):
        return F.from_json(F.lit(json.dumps(default)), field_.dataType)
    return F.lit(default).cast(field_.dataType)


def _read_as(value: Column, have: T.DataType, want: T.DataType, at: str) -> Column:
    if isinstance(have, T.StructType) and isinstance(want, T.StructType):
        return conform(value, have, want, f"{at}.")
    if have.simpleString() == want.simpleString():
        return value
    if isinstance(have, T.ArrayType) and isinstance(want, T.ArrayType):
        return F.transform(
            value, lambda v: _read_as(v, have.elementType, want.elementType, f"{at}.element")
        )
    if isinstance(have, T.MapType) and isinstance(want, T.MapType):
        if have.keyType != want.keyType:
            raise SchemaMismatch(f"field {at}: keys of a map cannot change their type")
        return F.transform_values(
            value, lambda _, v: _read_as(v, have.valueType, want.valueType, f"{at}.value")
        )
    kinds = have.simpleString(), want.simpleString()
    if kinds[0] != kinds[1] and kinds not in PROMOTIONS:
        raise SchemaMismatch(f"field {at}: {kinds[0]} cannot be read as {kinds[1]}")
    return value if kinds[0] == kinds[1] else value.cast(want)


def _required_nulls(value: Column, schema: T.StructType, path: str = ""):
    """Paths of the fields that must be there, each with whether it is missing in a value."""
    for f in schema.fields:
        at = f"{path}{f.name}"
        if not f.nullable:
            yield at, value.isNotNull() & value[f.name].isNull()
        yield from _nested_nulls(value[f.name], f.dataType, at)


def _nested_nulls(value: Column, dtype: T.DataType, at: str):
    if isinstance(dtype, T.StructType):
        yield from _required_nulls(value, dtype, f"{at}.")
        return
    if isinstance(dtype, T.ArrayType):
        items, inner, name = value, dtype.elementType, f"{at}.element"
    elif isinstance(dtype, T.MapType):
        items, inner, name = F.map_values(value), dtype.valueType, f"{at}.value"
    else:
        return
    def missing(of: int) -> Callable[[Column], Column]:
        return lambda v: F.coalesce(list(_nested_nulls(v, inner, name))[of][1], F.lit(False))

    # One pass over the items for each required field below them; null items hold none.
    for i, (path, _) in enumerate(_nested_nulls(F.lit(None).cast(inner), inner, name)):
        yield path, F.coalesce(F.exists(items, missing(i)), F.lit(False))

"""Spark types of Avro schema texts, as Spark's Avro module would read them."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import types as T

# Primitive and logical types of the Avro specification.
PRIMITIVE: Mapping[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "bytes": T.BinaryType(),
    "string": T.StringType(),
    "enum": T.StringType(),
    "fixed": T.BinaryType(),
}
LOGICAL: Mapping[tuple[str, str], T.DataType] = {
    ("int", "date"): T.DateType(),
    ("long", "timestamp-millis"): T.TimestampType(),
    ("long", "timestamp-micros"): T.TimestampType(),
    ("long", "local-timestamp-millis"): T.TimestampNTZType(),
    ("long", "local-timestamp-micros"): T.TimestampNTZType(),
}


def is_avro(schema: object) -> bool:
    """Whether a parsed schema text is an Avro record and not a Spark struct."""
    return isinstance(schema, dict) and schema.get("type") == "record"


# Unions that are read as the wider of their types.
WIDER: Mapping[frozenset[str], T.DataType] = {
    frozenset({"int", "long"}): T.LongType(),
    frozenset({"float", "double"}): T.DoubleType(),
}


def avro_struct(text: str) -> T.StructType:
    """The struct of an Avro record schema.

    A field that is a union with null is nullable. A union of int and long is a long, one of
    float and double a double; any other one of several types is a struct with a nullable field
    ``member0``, ``member1``, ... for each of them, null left out. A field's default and its
    aliases go to its metadata, where a decoder finds them.
    """
    parsed = json.loads(text)
    if not is_avro(parsed):
        raise ValueError("an Avro record schema is needed")
    return _record(parsed, "", {})


def _record(schema: dict, namespace: str, named: dict[str, T.DataType]) -> T.StructType:
    space = schema.get("namespace", namespace)
    fields = []
    for f in schema["fields"]:
        dtype, nullable = _type(f["type"], space, named)
        metadata = {k: f[k] for k in ("default", "aliases") if f.get(k) is not None}
        fields.append(T.StructField(f["name"], dtype, nullable, metadata))
    return T.StructType(fields)


def _full_name(name: str, namespace: str) -> str:
    return name if "." in name or not namespace else f"{namespace}.{name}"


def _union(
    schema: list, namespace: str, named: dict[str, T.DataType]
) -> tuple[T.DataType, bool]:
    kinds = [s for s in schema if s != "null"]
    nullable = len(kinds) < len(schema)
    if not kinds:
        return T.NullType(), True
    if len(kinds) == 1:
        return _type(kinds[0], namespace, named)[0], nullable
    wider = WIDER.get(frozenset(k if isinstance(k, str) else json.dumps(k) for k in kinds))
    if wider is not None:
        return wider, nullable
    members = [_type(k, namespace, named)[0] for k in kinds]
    return T.StructType([T.StructField(f"member{i}", t) for i, t in enumerate(members)]), nullable


def _type(schema, namespace: str, named: dict[str, T.DataType]) -> tuple[T.DataType, bool]:
    if isinstance(schema, list):
        return _union(schema, namespace, named)
    if isinstance(schema, str):
        known = PRIMITIVE.get(schema) or named.get(_full_name(schema, namespace))
        if known is None:
            raise ValueError(f"unknown or recursive Avro type {schema!r}")
        return known, False
    kind = schema["type"]
    if not isinstance(kind, str):
        return _type(kind, namespace, named)
    if kind == "array":
        element, nullable = _type(schema["items"], namespace, named)
        return T.ArrayType(element, nullable), False
    if kind == "map":
        value, nullable = _type(schema["values"], namespace, named)
        return T.MapType(T.StringType(), value, nullable), False
    logical = schema.get("logicalType")
    if logical == "decimal" and kind in ("bytes", "fixed"):
        dtype: T.DataType = T.DecimalType(schema["precision"], schema.get("scale", 0))
    elif kind == "record":
        dtype = _record(schema, namespace, named)
    else:
        dtype = LOGICAL.get((kind, logical)) or _type(kind, namespace, named)[0]
    if "name" in schema:
        named[_full_name(schema["name"], schema.get("namespace", namespace))] = dtype
    return dtype, False

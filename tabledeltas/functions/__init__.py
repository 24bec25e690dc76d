from tabledeltas.functions.avro_schema import avro_struct
from tabledeltas.functions.envelope import (
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

__all__ = [
    "AvroCodec",
    "CodecUnavailable",
    "JsonCodec",
    "SchemaMismatch",
    "accepted",
    "avro_struct",
    "decode_envelope",
    "frame_body",
    "frame_schema_id",
    "latest_schemas",
    "rejected",
]

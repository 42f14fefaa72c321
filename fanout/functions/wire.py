"""The message frame: one magic byte, a big-endian u32 schema id, then the datum."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = b"\x00"
HEADER_BYTES = 5


def build_frame(schema_id: Column, datum: Column) -> Column:
    return F.concat(F.lit(MAGIC), F.unhex(F.lpad(F.hex(schema_id.cast("long")), 8, "0")), datum)


def frame_magic(value: Column) -> Column:
    return F.substring(value, 1, 1) == F.lit(MAGIC)


def frame_schema_id(value: Column) -> Column:
    return F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("long")


def frame_datum(value: Column) -> Column:
    return F.substring(value, F.lit(HEADER_BYTES + 1), F.greatest(F.octet_length(value) - HEADER_BYTES, F.lit(0)))


def frame_problem(value: Column, schema_id: Column | int) -> Column:
    """Null for a good frame, else the first rule it breaks."""
    want = F.lit(schema_id) if isinstance(schema_id, int) else schema_id
    return (
        F.when(value.isNull() | (F.octet_length(value) <= HEADER_BYTES), F.lit("too short"))
        .when(~frame_magic(value), F.lit("magic byte"))
        .when(frame_schema_id(value) != want, F.lit("schema id"))
    )

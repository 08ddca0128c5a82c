"""Schemas of the working tables."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "binary": T.BinaryType(),
    "array<smallint>": T.ArrayType(T.ShortType()),
}


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])


EVENTS = _schema("song string, track_no int, track string, seq bigint, midi_time bigint, kind string, meta string, channel int, p1 int, p2 int, text string, data binary, tpq int")
GRID = _schema("song string, measure int, t_start bigint, t_end bigint")
PCM = _schema("song string, voice string, chunk bigint, frame0 bigint, n_channels int, rate int, samples array<smallint>")
SETTINGS = _schema("song string, key string, line bigint, value_text string, value_type string, value_long bigint, value_double double, value_bool boolean")
CUES = _schema("song string, n int, start_ms bigint, end_ms bigint, text string")

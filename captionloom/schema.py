"""Explicit schemas of the tables and the key columns. Times are BIGINT milliseconds."""

from __future__ import annotations

from pyspark.sql import types as T

_WORD = T.StructType([
    T.StructField("word", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
])

_SEGMENT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("start", T.DoubleType()),
    T.StructField("end", T.DoubleType()),
    T.StructField("words", T.ArrayType(_WORD)),
])

# one recognizer result; seconds as in the JSON files
TRANSCRIPT = T.StructType([
    T.StructField("rec_id", T.LongType()),
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("segments", T.ArrayType(_SEGMENT)),
])

CHUNK_MANIFEST = T.StructType([
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("start_time_ms", T.LongType()),
    T.StructField("end_time_ms", T.LongType()),
    T.StructField("duration_ms", T.LongType()),
])

GLOSSARY_JSON = T.StructType([
    T.StructField("exact_replace", T.MapType(T.StringType(), T.StringType())),
    T.StructField("pre_translate", T.MapType(T.StringType(), T.StringType())),
])

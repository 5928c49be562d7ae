"""Declared table schemas. Nothing in the package infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

BRONZE = T.StructType(
    [
        T.StructField("path", T.StringType(), True),
        T.StructField("file_name", T.StringType(), True),
        T.StructField("file_extension", T.StringType(), True),
        T.StructField("num_pages", T.IntegerType(), True),
        T.StructField("length", T.LongType(), True),
        T.StructField("year", T.StringType(), True),
        T.StructField("text", T.StringType(), True),
        T.StructField("status", T.StringType(), True),
    ]
)

# What a scan of binary files gives.
FILES = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("modificationTime", T.TimestampType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("content", T.BinaryType(), True),
    ]
)

RECURSIVE_CHUNK = T.StructType(
    [
        T.StructField("content", T.StringType(), True),
        T.StructField("char_length", T.IntegerType(), True),
        T.StructField("chunk_num", T.IntegerType(), True),
    ]
)

SEQUENTIAL_CHUNK = T.StructType(
    [
        T.StructField("content", T.StringType(), True),
        T.StructField("category", T.StringType(), True),
        T.StructField("char_length", T.IntegerType(), True),
        T.StructField("chunk_num", T.IntegerType(), True),
    ]
)

GLOSSARY = T.StructType(
    [
        T.StructField("file_name", T.StringType(), True),
        T.StructField("acronym", T.StringType(), True),
        T.StructField("definition", T.StringType(), True),
        T.StructField("certainty", T.IntegerType(), True),
    ]
)

# The fields of model responses and recorded tool messages.
GLOSSARY_ITEMS = "array<struct<acronym:string,definition:string,certainty:int>>"
MODEL_CHUNKS = "array<struct<chunk_number:int,content:string>>"
TOOL_CALL = "struct<id:string,name:string,arguments:string>"
TOOL_RESULT = "struct<id:string,content:string>"

# Fixed value: the columns of a search result, selected by name, never by position.
SEARCH_COLUMNS = [
    "uuid",
    "content",
    "category",
    "char_length",
    "chunk_num",
    "file_name",
    "file_extension",
    "num_pages",
    "length",
    "year",
]

"""Uploaded text files, and what is spilled or stored as JSON."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import SEPARATOR
from ..functions.text import strip


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file whole, as UTF-8; bytes that are none are dropped."""

    def of(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = [x.decode("utf-8", "ignore") for x in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(text, pa.string())], names=["path", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(of, "path string, text string")


def blocks(text: Column, blank_lines: bool = False) -> Column:
    """The texts of an upload, stripped, without empty ones: between separators; blank_lines: where there is no separator, between
    blank lines. Null: none."""
    t = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    parts = F.split(t, SEPARATOR)
    if blank_lines:
        parts = F.when(t.contains(SEPARATOR), parts).otherwise(F.split(t, r"\n\s*\n"))
    return F.filter(F.transform(parts, strip), lambda b: b != "")


def spill(df: DataFrame, path: str) -> DataFrame:
    """Writes a preview as JSON lines and reads it back with its schema."""
    df.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(df.schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Stores a table as JSON lines, one file: for results of a few rows, such as measures."""
    df.coalesce(1).write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """What write_json stored."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)

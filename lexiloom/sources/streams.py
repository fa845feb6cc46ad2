"""Streams as DataFrames: files of any text format to window rows, and back to text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexiloom.plans.batches import batches_of, rows_of
from lexiloom.plans.grammar import parse
from lexiloom.plans.rows import window_of, window_row
from lexiloom.schema import window_schema
from lexiloom.sources import codecs


def read_texts(texts: DataFrame, source: str = "", grammar: str = "") -> DataFrame:
    """Window rows of ``texts`` (doc_id, text): a text is a stream; null texts have no windows."""

    schema = window_schema()
    arrow = to_arrow_schema(schema)

    def read(rows: Iterator[dict]) -> Iterator[dict]:
        g = parse(grammar) if grammar else None
        for row in rows:
            text = row["text"]
            if text is not None:
                reader = codecs.FORMATS[source or codecs.detect(text)][0]
                yield from (window_row(row["doc_id"], k, w) for k, w in enumerate(reader(text, g), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(read(rows_of(batches)), arrow)

    return texts.select("doc_id", "text").mapInArrow(run, schema)


def read_files(spark: SparkSession, path: str, source: str = "", grammar: str = "") -> DataFrame:
    """Each file is a document, numbered by a hash of its name."""
    files = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), F.col("value").alias("text"))
    return read_texts(files, source, grammar)


def write_texts(windows: DataFrame, to: str = "cg") -> DataFrame:
    """(doc_id, win, text): each window in a text format."""

    arrow = pa.schema([("doc_id", pa.int64()), ("win", pa.int32()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ({"doc_id": r["doc_id"], "win": r["win"], "text": codecs.FORMATS[to][1]([window_of(r)])} for r in rows_of(batches))
        return batches_of(rows, arrow)

    return windows.mapInArrow(run, "doc_id long, win int, text string")

"""What the operators of this package share: reading tables, hiding clashing columns, small batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and the controls from tab to carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Rows that a task makes Python objects of at a time.
ROWS_AT_A_TIME = 1000
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named columns, under this operator's own names: extra columns can't clash."""
    return df.select(*[df[f"`{source}`"].alias(name) for name, source in columns.items()])


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def once(value: Column) -> Column:
    """``value`` as a generated column: filters on it stay above, so that the optimizer doesn't copy a long expression
    into them."""
    return F.explode(F.array(value))


def slices(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, fewer at a time: texts are long, and Spark hands over thousands. Nothing is copied."""
    for batch in rows:
        for at in range(0, batch.num_rows, ROWS_AT_A_TIME):
            yield batch.slice(at, ROWS_AT_A_TIME)


def batches(texts: list[Any], most_chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts with about ``most_chars`` characters; a longer text has a range of its own."""
    begin = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if size and size + n > most_chars:
            yield begin, i
            begin, size = i, 0
        size += n + 1
    if begin < len(texts):
        yield begin, len(texts)


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)



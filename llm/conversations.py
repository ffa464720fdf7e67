"""Rows of conversations in order, as a stream of Arrow batches in which conversations follow one another."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a streaming function holds before it hands them on, and the bytes of text among them.
OUT_ROWS, OUT_BYTES = 5_000, 8 << 20


def turns_of(conversations: DataFrame, missing: str = "") -> DataFrame:
    """``conv_id, turn, role, text`` alone, so that other columns can't clash; ``missing`` stands for a null role or text."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *filled)


def in_order(turns: DataFrame) -> DataFrame:
    """The turns with all of a conversation in one partition, one after the other: by turn, nulls first. Rows of one
    turn are ordered by role and text. The sort spills, so a conversation may be longer than memory."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)


class Rows:
    """Collects rows for batches of bounded size: ``put`` takes a row, ``full`` and ``batch`` hand them on."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def put(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.bytes += size

    @property
    def full(self) -> bool:
        return len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows, strict=True) if self.rows else [[] for _ in self.schema]
        arrays = [pa.array(column, field.type) for column, field in zip(columns, self.schema, strict=True)]
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays(arrays, schema=self.schema)

"""Helpers for functions over Arrow batches: bounded blocks of rows, and word caches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as objects at a time. One longer text is a block of its own.
BLOCK_BYTES = 4 << 20


def text_of(name: str = "text") -> Column:
    """The text column as the operators read it: null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_name: str = "doc_id", name: str = "text") -> DataFrame:
    """Only the two columns an operator needs, so that other columns of any name can't clash."""
    return docs.select(F.col(id_name).cast("long").alias("doc_id"), text_of(name).alias("text"))


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes in ``column``, one row at least."""
    if batch.num_rows == 0:
        return
    array = batch.column(column)
    sizes = pc.binary_length(array).fill_null(0).to_pylist()
    start, held = 0, 0
    for row, size in enumerate(sizes):
        if row > start and held + size > limit:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += size
    yield batch.slice(start)


class Cache(dict):
    """A dictionary that forgets everything once it is full, so that rare words can't fill the memory."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def room(self) -> None:
        """Call between blocks: what a block has just added must stay until the block is done."""
        if len(self) > self.limit:
            self.clear()

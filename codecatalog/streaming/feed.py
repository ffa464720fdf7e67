"""Change feeds as streaming DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codecatalog.functions.text import path_ext
from codecatalog.specs import SPECS

FEED_SCHEMA = "path string, change string, content binary, ts timestamp"


def watch_source(
    spark: SparkSession, directory: str, schema: str = FEED_SCHEMA, max_files: int | None = None
) -> DataFrame:
    """Unbounded feed of change rows that arrive as Parquet files."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(directory)


def relevant(changes: DataFrame, extensions: Iterable[str] | None = None) -> DataFrame:
    """Rows whose path has a wanted suffix; stateless."""
    wanted = list(extensions or [e for s in SPECS.values() for e in s.extensions])
    return changes.where(path_ext(F.col("path")).isin(wanted))


def change_label(code: Column) -> Column:
    """Watcher codes 1, 2, 3, or names, as added, modified, deleted."""
    text = code.cast("string")
    return (
        F.when(text.isin("1", "added"), "added")
        .when(text.isin("2", "modified"), "modified")
        .when(text.isin("3", "deleted"), "deleted")
    )


def change_log(changes: DataFrame, root: str = "") -> DataFrame:
    """``(path, change, ts)`` with corpus-relative paths."""
    prefix = root.rstrip("/") + "/" if root else ""
    relative = F.when(
        F.startswith(F.col("path"), F.lit(prefix)), F.substring("path", len(prefix) + 1, 1 << 30)
    ).otherwise(F.col("path"))
    return changes.select(relative.alias("path"), change_label(F.col("change")).alias("change"), "ts")

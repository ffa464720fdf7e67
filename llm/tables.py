"""Written intermediates: they cut lineage and are not computed twice."""

from __future__ import annotations

from pyspark.sql import DataFrame

from codecatalog.session import new_run_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once to the folder that all executors share and read from there."""
    path = new_run_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

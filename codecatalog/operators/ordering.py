"""Dense row numbers over a whole table without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codecatalog.session import ensure_checkpoint_dir, new_run_dir


def with_dense_order(df: DataFrame, *keys: str, name: str = "ord") -> DataFrame:
    """Number the rows 1..n in the order of ``keys``, which must be unique together.

    A range-partitioned sort gives each row an id of (partition, position); checkpointing fixes that
    layout. Only the row count of each partition is then ranked, so the ranked table has one row per
    partition whatever the data, and it is small enough to broadcast.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # A sort by ranges computes its input twice, first to find the ranges, so the input is written before.
    path = new_run_dir(spark, "unordered")
    df.write.parquet(path)
    placed = spark.read.schema(df.schema).parquet(path).orderBy(*keys).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    part, offset = F.shiftright("_id", 33), F.col("_id").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select(
        "_part",
        F.coalesce(
            F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("_start"),
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + offset + 1)
        .drop("_id", "_part", "_start")
    )

"""Sinks for pages and reports."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from codecatalog.sources.state import current_version
from codecatalog.sources.tree import mounted_path


def write_pages(pages: DataFrame, directory: str) -> None:
    """The page table of record."""
    pages.write.mode("overwrite").parquet(f"{directory}/pages")


def write_page_log(pages: DataFrame, gone: DataFrame, root: str, version: int) -> None:
    """The pages that ``version`` writes, and those it takes away (``gone(page_path)``), as one version of a log."""
    target = f"{root}/pages/data/v={version}"
    pages.select("page_path", "content").write.mode("overwrite").parquet(target)
    gone.select("page_path", F.lit(None).cast("string").alias("content")).write.mode("append").parquet(target)


def read_pages(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The site as of a version, the last committed one by default: of each page what was written last."""
    version = current_version(spark, f"{root}/state") if version is None else version
    if version is None:
        return spark.createDataFrame([], "page_path string, content string")
    log = spark.read.schema("page_path string, content string, v bigint").parquet(f"{root}/pages/data").where(F.col("v") <= version)
    last = log.groupBy("page_path").agg(F.max_by(F.struct("content"), "v").alias("last"))
    return last.where("last.content IS NOT NULL").select("page_path", "last.content")


def write_page_files(pages: DataFrame, directory: str) -> None:
    """One file per page below a folder that every executor mounts.

    Each file is written aside and renamed, so a retried task leaves the same result.
    """
    root = mounted_path(directory)
    if root is None:
        raise ValueError(f"single page files need a mounted folder, not {directory}")

    def save(rows: Iterator[Row]) -> None:
        for row in rows:
            target = os.path.join(root, row.page_path)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            aside = f"{target}.{uuid.uuid4().hex}.part"
            with open(aside, "w", encoding="utf-8") as out:
                out.write(row.content)
            os.replace(aside, target)

    pages.select("page_path", "content").foreachPartition(save)


def write_index(fragments: DataFrame, directory: str) -> None:
    """Index fragments as text files whose concatenation in name order is the index page."""
    fragments.orderBy("part", "module_ord").select("content").write.mode("overwrite").option(
        "lineSep", "\n"
    ).text(directory)


def write_report(report: DataFrame, directory: str) -> None:
    """``summary`` as one JSON row; changes and errors as JSON lines beside it."""
    body = report.select("section", F.col("body").alias("value"))
    body.where("section = 'summary'").select("value").coalesce(1).write.mode("overwrite").text(
        f"{directory}/summary"
    )
    body.where("section <> 'summary'").write.mode("overwrite").partitionBy("section").text(
        f"{directory}/details"
    )

"""Change feed and build report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codecatalog.functions.text import path_stem

CHANGE_COLUMNS = ("name", "module", "kind", "action", "line")


def file_changes(diff: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    action = (
        F.when(F.col("status") == "added", "added")
        .when(F.col("status") == "modified", "modified")
        .when(F.col("status") == "deleted", "removed")
    )
    return diff.where("status <> 'unchanged'").select(
        F.when(F.col("status") == "deleted", name).otherwise(path_stem(F.col("path"))).alias("name"),
        path_stem(F.col("path")).alias("module"),
        F.lit("file").alias("kind"),
        action.alias("action"),
        F.lit(0).cast("bigint").alias("line"),
    )


def fill_changes(suggestions: DataFrame) -> DataFrame:
    return suggestions.select(
        "name",
        path_stem(F.col("path")).alias("module"),
        "kind",
        F.lit("added").alias("action"),
        F.col("line").cast("bigint").alias("line"),
    )


def deprecated_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.where("is_deprecated")


def deprecation_changes(symbols: DataFrame) -> DataFrame:
    return deprecated_symbols(symbols).select(
        F.when(F.col("kind") == "method", F.concat("parent_name", F.lit("."), "name"))
        .otherwise(F.col("name"))
        .alias("name"),
        F.col("module_name").alias("module"),
        "kind",
        F.lit("deprecated").alias("action"),
        F.col("line_number").alias("line"),
    )


def change_feed(
    diff: DataFrame | None, symbols: DataFrame, suggestions: DataFrame | None = None
) -> DataFrame:
    """File changes, filled documentation and deprecations as one table."""
    feed = deprecation_changes(symbols)
    if diff is not None:
        feed = feed.unionByName(file_changes(diff))
    if suggestions is not None:
        feed = feed.unionByName(fill_changes(suggestions))
    return feed


def changes_with(changes: DataFrame, action: str) -> DataFrame:
    return changes.where(F.col("action") == action)


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("action").agg(F.count("*").alias("n_changes"))


def build_report(
    changes: DataFrame,
    project: DataFrame,
    status: DataFrame,
    *,
    source: str,
    output: str,
    format: str,
    incremental: bool,
    errors: DataFrame | None = None,
) -> DataFrame:
    """The report as rows ``(section, body)``: one summary, then one row per change and per error.

    The change list grows with the corpus, so it is never put into one value. ``project``, ``status``
    and the counts are one row each. ``changes`` is read twice; hand in a written table.
    """
    filled = (F.col("action") == "added") & (F.col("kind") != "file")
    counts = changes.agg(
        F.count_if(F.col("action") == "deprecated").alias("deprecated"), F.count_if(filled).alias("ai_filled")
    )
    parts = project.unionByName(status, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True)
    # One page per module and the index.
    one = parts.agg(*[F.max(c).alias(c) for c in parts.columns]).withColumn(
        "files_generated", F.col("n_modules") + 1
    )
    summary = F.struct(
        F.lit(source).alias("source"),
        F.lit(output).alias("output"),
        F.lit(format).alias("format"),
        F.lit(incremental).alias("incremental"),
        F.struct(
            "files_scanned",
            "files_changed",
            "files_deleted",
            "files_unchanged",
            "files_generated",
            F.col("n_modules").alias("modules"),
            F.col("n_functions").alias("functions"),
            F.col("n_classes").alias("classes"),
            "deprecated",
            "ai_filled",
        ).alias("summary"),
    )
    rows = one.select(F.lit("summary").alias("section"), F.to_json(summary).alias("body")).unionByName(
        changes.select(F.lit("change").alias("section"), F.to_json(F.struct(*CHANGE_COLUMNS)).alias("body"))
    )
    if errors is not None:
        rows = rows.unionByName(
            errors.select(F.lit("error").alias("section"), F.to_json(F.struct("path", "reason")).alias("body"))
        )
    return rows
